"""Each operator against brute force on awkward rows: nulls, empties, repeats, ties, clashing names, empty tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.llm import ann, chosen_path, html_text, lm_score, mixing, packing, quality, suffix_array, suffix_dedup, toxicity, url_filter


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- op1
def test_rules_longest_wins(spark):
    urls = [
        (1, "http://a.org/x"), (2, "http://www.example.org/es/1"), (3, "http://example.org/en/12?q"), (4, "HTTP://M.X.COM/fr/a#b"),
        (5, "http://x.com/de/"), (6, "http://x.net/de/"), (7, None), (8, "no url"), (9, "http://notexample.org/es/"), (None, "http://x.net"),
        (10, "http://x.com"), (10, "http://x.com"),
    ]
    pages = spark.createDataFrame([(i, u, "<p>the word list of words</p>", "c") for i, u in urls], "page_id long, url string, html string, host string")
    got = url_filter.judge(pages)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    by = {r.page_id: r for r in got.collect()}
    assert got.count() == len(urls)
    assert (by[1].rule, by[1].verdict) == ("org/", "allow")
    assert (by[2].rule, by[2].verdict) == ("example.org/es/", "block")
    assert (by[3].rule, by[3].verdict, by[3].path) == ("example.org/en/1", "block", "/en/12")
    assert (by[4].rule, by[4].verdict, by[4].host, by[4].path) == ("com/fr/", "allow", "m.x.com", "/fr/a")
    assert by[5].verdict == "block" and by[6].rule is None and by[9].rule == "org/"
    assert (by[7].host, by[7].path, by[7].rule) == ("", "", None) and by[8].host == ""
    assert by[None].host == "x.net" and by[None].path == ""
    assert {r.verdict for r in by.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_lexicon_and_words_of_hosts(spark):
    pages = spark.createDataFrame([("one " * 9 + "two " * 5 + "red blue " * 2 + "once " + "x" * 70 + " " + "x" * 70,)], "html string")
    counts = url_filter.lexicon(pages)
    assert {tuple(r) for r in counts.collect()} == {("one", 9), ("two", 5), ("red", 2), ("blue", 2)}
    hosts = spark.createDataFrame([("onetwo.redone.com",), ("1.2",), ("",), ("y" * 5000 + ".one",)], "host string")
    got = {r.host: r.words for r in url_filter.host_words(hosts, counts).collect()}
    assert got["onetwo.redone.com"][:4] == ["one", "two", "red", "one"]
    assert got["y" * 5000 + ".one"] == ["y" * 5000, "one"] and set(got) == {"onetwo.redone.com", "y" * 5000 + ".one"}
    assert url_filter.lexicon(pages.limit(0)).count() == 0


def test_verdicts_by_brute_force(spark):
    """Every verdict and its log odds from plain counts over all decided urls."""
    rng = np.random.default_rng(4)
    names, paths = ["redone", "bluetwo", "onered", "twoblue", "redblue"], ["/de/", "/fr/", "/x/a1", "/y/22", "/de/b", "/fr/b"]
    urls = [f"http://{rng.choice(names)}.{rng.choice(['com', 'net', 'org', 'example.org'])}{rng.choice(paths)}{rng.choice(['', 'z', 'b/c'])}" for _ in range(200)]
    urls += [None, "nothing", "http://" + "redone" * 2000 + ".net/" + "b/" * 5000]
    html = "one " * 9 + "two " * 5 + "red blue " * 7 + "de net org com " * 3
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    n = collections.Counter(url_filter.LETTERS.findall(html))
    total = sum(n.values()) * len(urls)
    words = {w: math.log(c * len(urls) / total) for w, c in n.items()}

    def tokens(r):
        host = ["h:" + w for label in url_filter.LETTERS.findall(r.host) for w in url_filter.segment(label, words)]
        return host + url_filter.path_tokens([r.path])["tokens"][0]

    counts, urls_of = {"block": collections.Counter(), "allow": collections.Counter()}, collections.Counter()
    for r in got.values():
        if r.rule is not None:
            counts[r.verdict].update(tokens(r))
            urls_of[r.verdict] += 1
    known = len(set(counts["block"]) | set(counts["allow"]))
    size = {c: sum(counts[c].values()) + 0.5 * known for c in counts}
    assert urls_of["block"] and urls_of["allow"]
    verdicts = set()
    for r in got.values():
        odds = math.log(urls_of["block"] + 0.5) - math.log(urls_of["allow"] + 0.5)
        for t in tokens(r):
            odds += math.log((counts["block"][t] + 0.5) / size["block"]) - math.log((counts["allow"][t] + 0.5) / size["allow"])
        assert r.block_log_odds == pytest.approx(odds, rel=1e-6, abs=1e-6)
        if r.rule is None:
            assert r.verdict == ("block" if odds > 0 else "allow")
            verdicts.add(r.verdict)
    assert verdicts == {"allow", "block"}


def test_segmentation_is_the_best_of_all_splits():
    words = {w: math.log(p) for w, p in {"th": 0.1, "the": 0.3, "her": 0.05, "on": 0.2, "eron": 0.01, "tion": 0.2, "er": 0.14}.items()}

    def cost(parts):
        return sum(words.get(p, -12.0 - 4.0 * len(p)) for p in parts)

    def splits(s):
        return [[s]] + [[s[:i], *rest] for i in range(1, len(s)) for rest in splits(s[i:])]

    for label in ("theron", "thtion", "therhe", "xq", "the", "tiontheron"):
        got = url_filter.segment(label, words)
        assert "".join(got) == label
        assert cost(got) == pytest.approx(max(cost(s) for s in splits(label) if max(map(len, s)) <= url_filter.LONGEST))


# ---------------------------------------------------------------- op2
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="x">Menu one, two.</a></li></ul></nav><div class="ad">Buy now, it is cheap.</div>
<div id="cookie-notice">We use cookies, as all do.</div>
<article><h1>A  title</h1><p>First &amp; long   paragraph, with <b>marks</b>, and words.<br>More of it.<p>Second one &lt;here&gt;, it says &eacute;.
<ul><li>Point one</li><li>Point two</li></ul><form><p>Your name, please.</p></form></article>
<aside><p>Related, and other things, you know.</p></aside><section class="comments"><p>I like it, a lot, really.</p></section>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", PAGE, "x"), (4, "u", "plain", "x")], "page_id long, url string, html string, text string")
    by = collections.defaultdict(list)
    for r in html_text.extract(pages).collect():
        by[r.page_id].append(r)
    want = "A title\n\nFirst & long paragraph, with marks, and words. More of it.\n\nSecond one <here>, it says é.\n\nPoint one\n\nPoint two"
    assert by[1][0].text == want == by[3][0].text
    assert by[1][0].n_chars == len(want)
    assert by[2][0].text == "" and by[2][0].n_chars == 0 and by[None][0].text == ""
    assert by[4][0].text == "plain"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_article_of_several_elements_is_whole():
    prose = [f"<p>Sentence {i}, with words, marks; and more of them, so that it is long.</p>" for i in range(10)]
    plain = [p[3:-4] for p in prose]
    whole = "\n\n".join(plain)
    for page in ("<article><h1>Title</h1><div class=body>%s</div></article>", "<div><div><h1>Title</h1><div class=body>%s</div></div><p>x</p></div>"):
        assert html_text.content("<body>" + page % "".join(prose) + "</body>").startswith("Title\n\n" + whole)
    sections = f"<article><section>{''.join(prose[:6])}</section><section>{''.join(prose[6:])}</section></article>"
    assert html_text.content(f"<body>{sections}</body>") == whole
    items = "".join(f"<li>{p}</li>" for p in plain[3:])
    assert html_text.content(f"<body><article>{''.join(prose[:3])}<ul>{items}</ul></article></body>") == whole
    # On a chosen path, though outside of the element that holds nearly all.
    assert "Outside" in html_text.content(f"<body><div><article>{''.join(prose * 3)}</article></div><div><article><p>Outside, {plain[0]}</p></article></div></body>")


@pytest.mark.parametrize(
    "wrapper",
    ['div class="page has-sidebar"', 'div class="content-with-sidebar"', 'div class="no-sidebar"', 'div class="site has-header"', 'div class="post-search-result"',
     'div id="main-thread"', "form", "fieldset", 'div class="sidebar"'],
)
def test_names_of_wrappers_do_not_remove_the_page(wrapper):
    prose = "".join(f"<p>Sentence {i}, with words, marks; and more of them, so that it is long.</p>" for i in range(10))
    noise = '<nav><p>Menu one, two, three, four.</p></nav><div class="site-header"><p>A site, of pages.</p></div><div class="comments"><article><p>I like it, a lot, really.</p></article></div>'
    want = html_text.content(f"<body><div>{prose}</div></body>")
    tag = wrapper.split()[0]
    assert want.count("Sentence") == 10
    for inner in (f"<article>{prose}</article>", f"<main>{prose}</main>"):
        assert html_text.content(f"<body><{wrapper}>{inner}{noise}</{tag}></body>") == want
    side = '<div class="side-bar"><p>Related, and other things.</p></div>'
    assert html_text.content(f"<body><{wrapper}>{prose}{side}</{tag}></body>") == want


def test_long_page_is_whole():
    body = "".join(f"<p>Paragraph {i}, with some text.</p>" for i in range(5000))
    assert html_text.content(f"<body><nav>x</nav><div>{body}</div></body>").count("\n\n") == 4999


# ---------------------------------------------------------------- op3
def test_base_score_is_exact(docs, no_docs):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    rows = [(r.doc_id, split((r.text or "").encode().lower().decode()) + [None]) for r in docs.collect()]
    seen = collections.Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(seen.values()), len(seen)
    want = sorted(
        (
            (i, held(i), len(t), sum(seen[w] > 0 for w in t), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6))
            for i, t in rows
        ),
        key=repr,
    )
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(docs).collect()), key=repr)
    assert got == want
    assert lm_score.score(no_docs).count() == 0


def model_by_hand(train, order):
    """log10 probability of a text (tokens between two ends) by the definition of the automaton, and its parts."""
    one = collections.Counter(w for t in train for w in t[1:])
    runs = [one] + [collections.Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(2, order + 1)]
    n, v = sum(one.values()), len(one)
    times = lambda run: one[run[0]] if len(run) == 1 else runs[len(run) - 1][tuple(run)]
    class_ = lambda state: (len(state), int(math.log2(times(state))))
    arcs = collections.defaultdict(lambda: [0, 0])
    for counted in runs[1:]:
        for run, c in counted.items():
            arcs[class_(run[:-1])][0] += 1
            arcs[class_(run[:-1])][1] += c
    fail = {k: (t + 0.5) / (t + m + 1) for k, (t, m) in arcs.items()}
    base = lambda w: math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))

    def step(state, w):
        cost = 0.0
        while state:
            if times(state):
                if times((*state, w)):
                    return cost + math.log10((1 - fail[class_(state)]) * times((*state, w)) / times(state))
                cost += math.log10(fail[class_(state)])
            state = state[1:]
        return cost + base(w)

    score = lambda t: sum(step(tuple(t[max(0, i - order + 1) : i]), t[i]) for i in range(1, len(t)))
    return score, step, runs


@pytest.mark.parametrize("order", [2, 3, 4])
def test_score_equals_the_automaton_by_hand(spark, order):
    draw = np.random.default_rng(order)
    texts = [(i, " ".join(draw.choice(list("abcdefgh"), draw.integers(0, 14)).tolist())) for i in range(70)] + [(200, "new a words"), (201, "new a words")]
    texts += [(202, None), (203, "a b " * 2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = {r.doc_id: r for r in lm_score.score(docs, order).collect()}
    cut_ = lambda t: [None, *(t or "").split(), None]
    score, step, runs = model_by_hand([cut_(t) for i, t in texts if zlib.crc32(str(i).encode()) % 10], order)
    for i, t in texts:
        assert made[i].score == pytest.approx(score(cut_(t)))
    states = {run[:-1] for run in runs[-1]} | {(w,) for w in runs[0]}
    for state in list(states)[:100]:  # arcs of a state and what its failure leads to
        assert sum(10 ** step(state, w) for w in runs[0]) <= 1 + 1e-9


def test_ranges_of_hashes_follow_the_input_and_change_nothing(spark, docs, monkeypatch):
    want = sorted(((r.doc_id, round(r.score, 9)) for r in lm_score.score(docs).collect()), key=repr)
    monkeypatch.setattr(lm_score, "RANGE", lm_score.BLOCK // 30)  # 30 ranges a block
    assert sorted(((r.doc_id, round(r.score, 9)) for r in lm_score.score(docs).collect()), key=repr) == want


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_score.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


# ---------------------------------------------------------------- op4
def test_quality_counts(docs, no_docs):
    want = []
    for r in docs.collect():
        t = r.text or ""
        w = split(t)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if split(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    got = quality.judge(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    assert all(not r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert quality.judge(no_docs).count() == 0


# ---------------------------------------------------------------- op5
def jaccard_classes(rows):
    sets = [frozenset(x.tolist()) for x in chosen_path.shingle_sets([t or "" for _, t in rows])]
    root, links = list(range(len(rows))), [0] * len(rows)
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    best = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], best[find(i)], links[i]) for i in range(len(rows))), key=repr)


def test_join_equals_brute_force(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(chosen_path.join(docs)) == jaccard_classes(rows)
    assert chosen_path.join(no_docs).count() == 0


def test_split_buckets_and_tiled_families_equal_brute_force(spark):
    """Rooms so small that buckets split, stay too large, and families need several tiles."""
    rng = np.random.default_rng(3)
    line = " ".join(f"c{i}" for i in range(12))
    rows = []
    for k in range(60):
        own = [f"d{k}_{i}" for i in range(30)]
        rows.append((k, line + " " + " ".join(own)))
    group = [f"g{i}" for i in range(120)]
    for k in range(40):
        mine = list(group)
        for p in rng.integers(0, 120, 2):
            mine[p] = f"m{k}"
        rows.append((100 + k, " ".join(mine)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(chosen_path.join(docs, room=8, depth=2, tile=8)) == jaccard_classes(rows)


def test_isolated_pairs_in_buckets_split_three_times(spark):
    """Pairs at 0.8 that share only shingles of large buckets: all have the same common words, pairs are told apart by which of them."""
    rng = np.random.default_rng(5)
    common = rng.integers(-(2**62), 2**62, 100)
    rows, pairs = [], []
    for p in range(1200):
        shared = rng.permutation(common)[:80]
        pairs.append((2 * p, 2 * p + 1))
        for s in pairs[-1]:
            own = rng.integers(-(2**62), 2**62, 10)  # 80 of 100 shingles shared: similarity 0.8
            values = np.unique(np.concatenate([shared, own])).astype(np.uint64)
            sizes = np.full(len(values), len(values))
            take = lambda count, seed: values[chosen_path.drawn(values, sizes, count, seed)].astype(np.int64).tolist()  # noqa: B023, E731
            rows.append((s, take(chosen_path.RUNS, 0x5EED), take(2 * chosen_path.RUNS, 0x5EED), take(chosen_path.POOL, 0xF00D)))
    reps = spark.createDataFrame(rows, "s long, draws array<long>, twice array<long>, pool array<long>")
    # Buckets of the last level only: in blocks of one set nothing is small enough before.
    held = collections.defaultdict(set)
    for r in chosen_path.buckets(reps, 1, 3, 1).select("path", "s").collect():
        held[r.s].add(r.path)
    missed = sum(not held[a] & held[b] for a, b in pairs)
    assert missed == 0


def test_buckets_up_to_some_blocks_are_compared_whole(spark):
    rows = [(s, [7], [7], [7]) for s in range(24)]
    reps = spark.createDataFrame(rows, "s long, draws array<long>, twice array<long>, pool array<long>")
    assert rows_of(chosen_path.buckets(reps, 3, 3, 8).select("path", "s", "size")) == sorted(((7, s, 24) for s in range(24)), key=repr)


def test_one_of_each_class_stays(docs):
    stays = chosen_path.one_each(docs)
    assert stays.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in stays.collect())
    assert ids[0] == 1 and not ids[1] and not ids[2] and ids[6] == 1 and ids[3] == ids[4] == ids[5] == 1 and ids[13] == 2 and ids[None] == 1


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in chosen_path.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# ---------------------------------------------------------------- op6
def test_mix_is_near_its_targets(docs, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7)))
    assert mixing.mix(no_docs).count() == 0


def test_mixed_rows_follow_the_mix(docs):
    many = mixing.mixed(docs)
    assert many.columns == docs.columns
    assert many.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == mixing.mix(docs).agg(F.sum("taken")).first()[0]


# ---------------------------------------------------------------- op7
def brute_removal(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def test_removal_equals_brute_force(docs, no_docs):
    rows = docs.collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, brute_removal([r.text for r in rows]), strict=True)), key=repr)
    assert rows_of(suffix_dedup.report(docs)) == want
    assert suffix_dedup.report(no_docs).count() == 0


def test_removal_of_common_keys_string_by_string(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = word(60)
    texts = [word(20) + " " + passage + " " + word(20) for _ in range(20)] + ["ab" * 400, "ab" * 150, word(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((i, *x) for i, x in enumerate(brute_removal(texts))), key=repr)
    for room in (2_000, 4_000_000):
        losing, _ = suffix_dedup.spans(docs, room=room)
        got = {r.row: r for r in losing.mapInArrow(suffix_dedup._remove, suffix_dedup.REST).collect()}
        assert sum(r.removed for r in got.values()) == sum(x[2] for x in want)
        assert {r.sha for r in got.values() if r.removed} == {x[4] for x in want if x[2]}


def test_cleaned_texts(docs):
    got = suffix_dedup.cleaned(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text is None and by[10].text is not None and "w5030" not in by[7].text and "w110" in by[7].text


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(60):
        t = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 400)).astype(np.uint8)
        t = np.tile(t[: max(1, len(t) // 7)], 7) if trial % 3 == 0 else t
        b = t.tobytes()
        order = suffix_array.suffix_array(t)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023
        before, prefix = suffix_array.common_prefixes(t, order, len(t) + 1)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            n = 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert before[i] == j and prefix[i] == n


# ---------------------------------------------------------------- op8
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, norm string")


def test_search_is_right_where_few_vectors_are(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16)).astype(np.float32)
    x[7] = x[5]
    x[:, 0] *= 3  # unequal norms
    rows = [(i, v.tolist(), 0, "c", "c") for i, v in enumerate(x)]
    rows += [(100, None, 0, "c", "c"), (120, [0.0] * 16, 0, "c", "c"), (140, [float("nan")] * 16, 0, "c", "c"), (None, x[3].tolist(), 0, "c", "c"), (160, [None] * 16, 0, "c", "c"), rows[4]]
    got = ann.search(vectors(spark, rows), F.col("id") % 20 == 0, tables=12, probes=32).collect()
    d = x.astype(np.float64)
    for q in (0, 20, 40):
        score = {i: float((d[i] * d[q]).sum()) for i in range(60) if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]  # noqa: B023
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == want and [r.score for r in mine] == pytest.approx([score[i] for i in want], abs=1e-12)
    assert {r.query_id for r in got} == {0, 20, 40}
    assert ann.search(vectors(spark, []), F.col("id") % 20 == 0).count() == 0


def test_recall_and_crowded_buckets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = rows.collect()
    x, ids = np.array([r.embedding for r in t]), np.array([r.vec_id for r in t])
    found = collections.defaultdict(set)
    for r in ann.search(rows, F.col("id") % 20 == 0, room=8).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -9
        hits.append(len(set(ids[np.argsort(-score)[:20]].tolist()) & found[ids[q]]) / 20)
    assert np.mean(hits) >= 0.9


def recall(spark, ids, x, **how):
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in ann.search(rows, F.col("id") % 20 == 0, **how).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(set(ids[np.argsort(-score)[:20]].tolist()) & found[ids[q]]) / 20)
    return np.mean(hits), min(len(v) for v in found.values()), len(found)


@pytest.mark.parametrize("norms", ["spread", "outlier", "hashed spread"])
def test_recall_of_unequal_norms(spark, norms):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").dropDuplicates(["vec_id"]).collect()
    x, ids = np.array([r.embedding for r in t], dtype=np.float64), np.array([r.vec_id for r in t])
    if norms == "outlier":
        x[1] *= 10
    else:
        x *= np.random.default_rng(0).uniform(0.5, 1.5, (len(x), 1))
    got, least, answered = recall(spark, ids, x, **({"few": 0} if norms == "hashed spread" else {}))
    assert got >= 0.9 and least == 20 and answered == (ids % 20 == 0).sum()


def test_queries_without_near_buckets_are_filled_up(spark):
    x = np.random.default_rng(1).normal(size=(60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, np.arange(60), x) == (1.0, 20, 3)
    assert recall(spark, np.arange(60), x, few=0, room=7, tables=1, probes=1) == (1.0, 20, 3)


# ---------------------------------------------------------------- op9
def test_index_finds_the_exact_nearest():
    rng = np.random.default_rng(0)
    bags = [{int(t): int(rng.integers(1, 5)) for t in rng.integers(0, 40, 6)} | {40: int(rng.integers(5, 300))} for _ in range(400)]
    index = toxicity.Index([f"t{i}" for i in range(40)], rng.random(41) + 1, bags, rng.integers(0, 2, 400), list(range(400)))
    dense = np.zeros((400, 41))
    for k, b in enumerate(bags):
        at, w = index.vector(b)
        dense[index.place[k], at] = w
    for b in bags[:50]:
        at, w = index.vector(b)
        want = np.sort(dense[:, at] @ w)[::-1][: toxicity.K]
        assert np.allclose(index.nearest(b)[1], want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, labels).collect()]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01


def labelled(spark, n, every, seed=0):
    """n texts of random words, every so many toxic by two of five words; labels for all."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        said = [f"w{rng.integers(0, 400)}" + "abcdefgh"[int(rng.integers(0, 8))] * 2 for _ in range(30)]
        if i % every == 0:
            for w in rng.choice(["vile", "nasty", "scummy", "rotten", "filthy"], 2, replace=False):
                said.insert(int(rng.integers(0, 30)), str(w))
        rows.append((i, " ".join(said), int(i % every == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), rows


@pytest.mark.parametrize("taught", [13, 32, 76, 400])
def test_toxicity_learns_from_any_number_of_labels(spark, taught):
    docs, labels, rows = labelled(spark, 600, 4)
    few = labels.orderBy(F.xxhash64("doc_id")).limit(taught)
    known = {r.doc_id for r in few.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, few).collect()}
    bad, good = ([got[i] for i, _, t in rows if i not in known and t == c] for c in (1, 0))
    rank = np.mean([[(a > b) + 0.5 * (a == b) for b in good] for a in bad])
    assert rank > (0.55 if taught < 30 else 0.75), rank
    assert np.mean([s >= 0.5 for s in good]) < 0.1


def test_toxicity_scores_by_brute_force(spark):
    """Votes of the nearest examples by dense cosines over TF x IDF x evidence, through the curve."""
    docs, labels, rows = labelled(spark, 300, 3, seed=2)
    got = {r.doc_id: (r.score, r.evidence) for r in toxicity.score(docs, labels).collect()}
    index, _ = toxicity.train(docs, labels)
    texts = {i: toxicity.plain(t) for i, t, _ in rows}

    def vector(said):
        counts = np.array([sum(said.startswith(n, k) for k in range(len(said))) for n in index.names] + [said.count(" ") - 1], dtype=float)
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * index.weights
        return v / np.sqrt((v * v).sum())

    for j, name in enumerate(index.names[:20]):
        df = sum(name in t for t in texts.values())
        toxic, others = (sum(name.strip() in toxicity.terms(t) or name in toxicity.terms(t) for i, t, c in rows if c == k and i in set(index.ids.tolist())) for k in (1, 0))
        size = [int((index.toxic == k).sum()) for k in (0, 1)]
        part = (toxic + others) / sum(size)
        test = (toxic / size[1] - others / size[0]) ** 2 / (part * (1 - part) * (1 / size[0] + 1 / size[1]))
        assert index.weights[j] / (np.log((1 + len(rows)) / (1 + df)) + 1) <= 1
        assert test > 0
    held = np.stack([vector(texts[i]) for i in index.ids.tolist()])
    for i, _, _ in rows[:80]:
        cos = held @ vector(texts[i])
        near = np.sort(cos)[::-1][: toxicity.K]
        order = np.lexsort((np.arange(len(cos)), -cos))[: toxicity.K]
        w = cos[order] / (1.25 + 1e-6 - np.minimum(cos[order], 1))
        edge = np.sum(np.abs(cos - near[-1]) < 1e-9) > 1  # a tie for the last place: the vote may differ
        vote = (w * (2 * index.toxic[order] - 1)).sum() / w.sum()
        if not edge:
            assert got[i][0] == pytest.approx(index.score(vote), rel=1e-6)
        assert sorted(cos[index.ids.tolist().index(e)] for e in got[i][1]) == pytest.approx(sorted(near[:5]), rel=1e-9)


def test_toxicity_of_very_long_and_repeated_texts(spark):
    docs, labels, rows = labelled(spark, 200, 4, seed=3)
    long = " ".join(t for _, t, c in rows if not c) * 20
    more = spark.createDataFrame([(1, rows[1][1])] * 50 + [(1000, long), (1001, long + " vile nasty rotten filthy" * 3000)], docs.schema)
    got = {r.doc_id: r.score for r in toxicity.score(docs.unionByName(more), labels).collect()}
    assert got[1000] < 0.5 < got[1001]


def test_toxicity_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    few = spark.createDataFrame([(0, 1), (None, 1), (7, None), (10, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, few).count() == docs.count()
    assert toxicity.score(no_docs, few).count() == 0
    assert toxicity.accepted(docs, none).columns == docs.columns


# ---------------------------------------------------------------- op10
def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    import itertools

    for _ in range(25):
        m, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(np.arange(1, 40), m, replace=False)) * 8.0, rng.integers(1, 20, m)

        def cost(ends):
            return sum(c * min(e for e in ends if e >= v) for v, c in zip(lengths, counts, strict=True))  # noqa: B023

        got = packing.bounds(lengths, counts, k)
        best = min(cost(e) for r in range(1, min(k, m) + 1) for e in itertools.combinations(lengths, r) if lengths[-1] in e)
        assert len(got) <= k and got[-1] == lengths[-1] and cost(got) == best


def test_batches(docs, no_docs):
    got = packing.pack(docs, buckets=4, budget=256).collect()
    assert len(got) == docs.count()
    batches = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.padded
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.batch_rows for r in rows} == {len(rows)}
        assert len(rows) == 1 or len(rows) * rows[0].padded <= 256
    assert packing.pack(no_docs).count() == 0
