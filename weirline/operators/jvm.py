"""The ensembles' kernels in the JVM: ``Ensembles.java``, translated by the compiler Spark itself uses (Janino).

The driver translates once per application and adds the classes as a jar, which Spark
hands to the executors; nothing but Spark is needed on either side.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession
from pyspark.sql.classic.column import Column, _to_java_column, _to_seq

_SOURCE = Path(__file__).with_name("Ensembles.java")


def _class(spark: SparkSession, name: str):
    """The class as the driver knows it; the executors get all of them in a jar of the application."""
    context = spark.sparkContext
    with SparkContext._lock:
        if not hasattr(context, "_weirline_classes"):
            compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
            compiler.cook(_SOURCE.read_text())
            folder = tempfile.mkdtemp(prefix="weirline-jar-")
            atexit.register(shutil.rmtree, folder, True)
            with zipfile.ZipFile(f"{folder}/weirline.jar", "w") as jar:
                for made, code in dict(compiler.getBytecodes()).items():
                    jar.writestr(f"{made.replace('.', '/')}.class", bytes(code))
            context._jsc.addJar(f"{folder}/weirline.jar")
            context._weirline_classes = compiler.getClassLoader()
    return context._weirline_classes.loadClass(f"weirline.{name}")


def _function(spark: SparkSession, name: str, alg: str, settings: list[list[float]], chunk: int, seed: int, width: int, pack: tuple) -> Column:
    context, jvm = spark.sparkContext, spark._jvm
    flat = [v for point in settings for v in point]
    points, given = context._gateway.new_array(jvm.double, len(flat)), context._gateway.new_array(jvm.Object, 5)
    for i, v in enumerate(flat):
        points[i] = v
    for i, v in enumerate((alg, points, jvm.java.lang.Integer.valueOf(chunk), jvm.java.lang.Long.valueOf(seed), jvm.java.lang.Integer.valueOf(width))):
        given[i] = v
    made = _class(spark, name).getDeclaredConstructors()[0].newInstance(given)
    return Column(made.function().apply(_to_seq(context, pack, _to_java_column)))


def ensembles(spark: SparkSession, alg: str, settings: list[list[float]], chunk: int, seed: int, width: int, *pack: Column | str) -> Column:
    """array<array<double>>: per case to predict the value of every point of a grid; null for packs that teach or ask nothing.

    ``pack`` as in ``Ensembles.call``. The column counts as nondeterministic, so that Spark evaluates it once.
    """
    return _function(spark, "Ensembles", alg, settings, chunk, seed, width, pack)


def copies(spark: SparkSession, alg: str, setting: list[float], trees: int, seed: int, width: int, *pack: Column | str) -> Column:
    """array<double>: the predictions of rows and of their copies with one input from a donor; ``pack`` as in ``Copies.call``."""
    return _function(spark, "Ensembles$Copies", alg, [setting], trees, seed, width, pack)
