"""The range coder on Spark's JVM: TokenFiles.java with the constants of range_coder.py, compiled by the Janino that Spark brings along.

A coder that updates its model after every id goes step by step, which takes NumPy some ten times as long. The classes go to executors
as a jar that the driver serves, so nothing has to be installed or shared. The driver must have a JVM of its own (no Spark Connect).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import range_coder as r

#: Names of the two functions in SQL.
WRITE, READ = "skein_write_token_file", "skein_read_token_file"
_READS = ArrayType(StructType([StructField(x, LongType()) for x in ("doc_id", "at", "n_tokens", "ids_crc32")]))
#: Jars by application.
_jars: dict[str, str] = {}


def source(version: int) -> str:
    """The Java source with its constants."""
    lanes = r.Lanes(1, 1)

    def spelt(values: np.ndarray) -> str:
        return "".join(f"\\u{0x4000 + v:04x}" for v in values.tolist())

    def listed(values) -> str:
        return ", ".join(str(int(v)) for v in values)

    constants = {k: str(getattr(r, k)) for k in ("BLOCK", "SPACE", "LEAST", "SOME", "SLOTS", "SURE", "RATE", "PACE")}
    constants |= {"VERSION": str(version), "SQUASH": spelt(r._SQUASH), "STRETCH": spelt(r._STRETCH + 2047), "RIGHT1": listed(lanes.right1), "RIGHT2": listed(lanes.right2)}
    constants |= {"FIRST": listed(r.FIRST_WEIGHTS), "SECOND": listed(r.SECOND_WEIGHTS)}
    text = Path(__file__).with_name("TokenFiles.java").read_text()
    for name, value in constants.items():
        text = text.replace(f"@{name}@", value)
    return text


def _jar(spark: SparkSession, text: str) -> str:
    compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(text)
    folder = tempfile.mkdtemp(prefix="skein-jar-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/skein-token-files-{zlib.crc32(text.encode()):08x}.jar"
    with zipfile.ZipFile(path, "w") as jar:
        for name, code in dict(compiler.getBytecodes()).items():
            jar.writestr(name.replace(".", "/") + ".class", bytes(code))
    return path


def functions(spark: SparkSession, version: int) -> None:
    """Makes WRITE(documents, ids) and READ(file) known to the session; see TokenFiles.java for what they take."""
    if spark.catalog.functionExists(WRITE) and spark.catalog.functionExists(READ):
        return
    app = spark.sparkContext.applicationId
    if app not in _jars:
        _jars[app] = _jar(spark, source(version))
    spark.sql(f"ADD JAR '{_jars[app]}'")
    loader = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    for name, kind, returns in ((WRITE, "Write", BinaryType()), (READ, "Read", _READS)):
        function = loader.loadClass(f"skein.TokenFiles${kind}").newInstance()
        spark._jsparkSession.udf().register(name, function, spark._jsparkSession.parseDataType(returns.json()))
