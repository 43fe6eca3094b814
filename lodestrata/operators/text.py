"""Search, line metrics and token budgets over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodestrata.functions.names import keywords, match_score, tokens_estimate, words
from lodestrata.operators.series import running

# What starts a comment, and the words that add a branch, by language.
COMMENT = {"python": r"^\s*#", "javascript": r"^\s*(//|/\*|\*)", "typescript": r"^\s*(//|/\*|\*)", "go": r"^\s*(//|/\*|\*)", "java": r"^\s*(//|/\*|\*)"}
BRANCHES = r"\b(if|elif|for|while|case|catch|except|and|or)\b|&&|\|\|"


def symbol_search(symbols: DataFrame, query: str, k: int, name: str = "name", tie: Sequence[str] = ("id",)) -> DataFrame:
    """The k best names for a query with their score, all names considered; ties by name and then tie."""
    d = symbols.withColumn("score", match_score(query, F.col(name))).where("score > 0")
    return d.orderBy(F.desc("score"), name, *tie).limit(k)


def lines(d: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """(keep, line_no from 1, line): the lines of a text without their ends; null texts have none."""
    return d.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("__n", "line")).select(*keep, (F.col("__n") + 1).alias("line_no"), "line")


def grep(d: DataFrame, text: str, keep: Sequence[str], needle: str) -> DataFrame:
    """(keep, line_no, hit): lines that contain needle in any case, trimmed and cut to 100 characters; whole texts are searched."""
    found = d.where(F.lower(text).contains(needle.lower()))
    return lines(found, text, keep).where(F.lower("line").contains(needle.lower())).select(*keep, "line_no", F.substring(F.trim("line"), 1, 100).alias("hit"))


def line_metrics(d: DataFrame, text: str, keep: Sequence[str], comment: Column) -> DataFrame:
    """(keep, total, blank, comment, code) lines of each text; comment is a pattern column."""
    x = lines(d.withColumn("__c", comment), text, [*keep, "__c"])
    blank, com = F.trim("line") == "", F.expr("line rlike __c")
    x = x.groupBy(*keep).agg(F.count("*").alias("total"), F.count_if(blank).alias("blank"), F.count_if(~blank & F.coalesce(com, F.lit(False))).alias("comment"))
    return x.withColumn("code", F.col("total") - F.col("blank") - F.col("comment"))


def complexity(text: Column) -> Column:
    """One more than the branching words of a text."""
    return 1 + F.regexp_count(text, F.lit(BRANCHES))


def keyword_rows(d: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return d.select(*keep, F.explode(keywords(F.col(text))).alias("keyword"))


def keyword_names(keys: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """(keyword, name, shared, score): the k names that share most words with each keyword, by a join on words.

    Only distinct keywords and names meet, over an inverted index of their words; a pair's score is the share of the
    keyword's words. The top k is the feature.
    """
    a = keys.select("keyword").distinct().select("keyword", F.size(F.array_distinct(words(F.col("keyword")))).alias("n"), F.explode(F.array_distinct(words(F.col("keyword")))).alias("word"))
    b = names.select("name").distinct().select("name", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
    p = a.join(b, "word").groupBy("keyword", "name", "n").agg(F.count("*").alias("shared")).withColumn("score", F.col("shared") / F.col("n"))
    w = Window.partitionBy("keyword").orderBy(F.desc("score"), "name")
    return p.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select("keyword", "name", "shared", "score")


def token_budget(d: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, budget: int, width: float = 4096.0) -> DataFrame:
    """The rows of each key, in order, until their estimated tokens reach the budget; the one that crosses it is the last.

    Where order begins with a number, sums run over chunks of it of that width, so a key of very many rows is many tasks.
    """
    d = d.withColumn("tokens", F.coalesce(tokens_estimate(F.col(text)), F.lit(0).cast("long")))
    if isinstance(d.schema[order[0]].dataType, NumericType):
        d = running(d, keys, order, "tokens", "before", width)
    else:
        d = d.withColumn("before", F.sum("tokens").over(Window.partitionBy(*keys).orderBy(*order)))
    return d.withColumn("before", F.col("before") - F.col("tokens")).where(F.col("before") < budget)


def changed(current: DataFrame, stored: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """Rows of current whose md5 is not the stored one."""
    return current.withColumn("digest", F.md5(F.coalesce(F.col(text), F.lit("")))).join(stored.select(key, F.col(digest).alias("digest")).distinct(), [key, "digest"], "left_anti")


def keep_one(d: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first row of each key in order, or the last; of equal ones any. Partitions keep one row of a key before they are shuffled."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in d.columns if c not in keys]
    # a null order comes first, so a row of nulls is told from none
    g = d.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(F.lit(0), *order)).alias("__row"))
    return g.select(*keys, "__row.*").select(*d.columns)


def sections(d: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """(keep, line_no, section, item): list items of a text under the heading above them; null before the first."""
    x = lines(d, text, keep)
    w = Window.partitionBy(*keep).orderBy("line_no")
    head = F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)
    x = x.withColumn("section", F.last(F.when(head != "", head), True).over(w))
    item = F.regexp_extract("line", r"^\s*[-*]\s+(?:\[[ x]\]\s+)?(.*)$", 1)
    return x.withColumn("item", item).where("item <> ''").select(*keep, "line_no", "section", "item")


def parameter_count(signature: Column) -> Column:
    """Parameters of a signature: commas outside nested brackets of the first pair of parentheses, receiver words left out."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}", ""), r"\([^()]*\)", "")
    parts = F.filter(F.transform(F.split(flat, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin("self", "cls", "*", "/"))
    return F.size(parts)
