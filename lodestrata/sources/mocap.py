"""Motion-capture text: skeletons of begin/end blocks and frame files with a number line before each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_skeleton(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, parent, direction, length, axis, dof) of each bone; parent from the hierarchy section, null for none."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("v"))
    blocks = t.select("file", F.explode(F.regexp_extract_all("v", F.lit(r"(?s)\bbegin\s+(id\b.*?)(?:^|\s)end\b"), 1)).alias("b"))
    numbers = lambda key, n: F.transform(F.slice(F.split(F.trim(F.regexp_extract("b", rf"\b{key}\s+([^\n\r]*)", 1)), r"\s+"), 1, n), lambda x: x.cast("double"))
    dof = F.trim(F.regexp_extract("b", r"\bdof\s+([a-zA-Z \t]+)", 1))
    bones = blocks.select("file", F.regexp_extract("b", r"\bname\s+(\S+)", 1).alias("name"), numbers("direction", 3).alias("direction"), F.regexp_extract("b", r"\blength\s+(\S+)", 1).cast("double").alias("length"), numbers("axis", 3).alias("axis"), F.when(dof != "", F.split(dof, r"\s+")).otherwise(F.array().cast("array<string>")).alias("dof"))
    tree = t.select("file", F.explode(F.split(F.regexp_extract("v", r"(?s):hierarchy\s+begin(.*?)\bend\b", 1), r"\r?\n")).alias("line"))
    words = F.split(F.trim("line"), r"\s+")
    links = tree.where(F.size(words) > 1).select("file", words[0].alias("parent"), F.explode(F.slice(words, F.lit(2), F.size(words) - 1)).alias("name"))
    return bones.join(links, ["file", "name"], "left").select("file", "name", "parent", "direction", "length", "axis", "dof")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, bone, channels): a line with a whole number alone opens a frame, the lines after it are its bones."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    w = Window.partitionBy("file").orderBy("no")
    frame = F.regexp_extract(F.trim("line"), r"^(\d+)$", 1)
    t = t.withColumn("frame", F.last(F.when(frame != "", frame.cast("int")), True).over(w))
    t = t.where((frame == "") & F.col("frame").isNotNull() & F.trim("line").rlike(r"^[A-Za-z]\w*(\s+\S+)+$"))
    words = F.split(F.trim("line"), r"\s+")
    return t.select("file", "frame", words[0].alias("bone"), F.transform(F.slice(words, F.lit(2), F.size(words) - 1), lambda x: x.cast("double")).alias("channels"))
