"""URL filter: logistic regression on hashed character n-grams of host and path, under explicit rules.

DataFrame functions and spark.ml only. The model is trained from a small table
of labelled URLs; rules (host and path prefix) overrule it, the longest first.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import LOWER, UPPER, ascii_lower

GRAMS = (3, 4, 5)
BUCKETS = 1 << 15
#: Rules up to this number become one expression; more of them are joined by the host and its parent domains.
EXPRESSION_RULES = 200

#: Words of names that advertise, track or lure, and words of names that inform. Stems are pairs of them.
BAD_WORDS = "casino poker slots jackpot bets lottery prize winner pills pharmacy diet cure loans payday credit cheap discount free bonus replica luxury spam farm links followers clicks track pixel ads popunder banner adult cams dating crack keygen".split()
GOOD_WORDS = "library museum weather recipe garden news science history college harbour city river school council theatre orchestra hospital railway parish mountain wiki archive journal forum docs open map travel book village cinema sport nation station northern health mother other thermal the and".split()
LABEL_HOSTS = ("www.{}.com", "{}.org", "m.{}.net", "blog.{}.com", "{}.info", "{}.co")
LABEL_PATHS = ("/en/12", "/de/7.html", "/fr/403/", "/es/99?page=2&ref=x", "/", "")


def stems(words: list[str], steps: tuple[int, ...]) -> list[str]:
    """The words, and each joined to the one `step` places on, with and without a hyphen."""
    pairs = [(w, words[(k + step) % len(words)]) for step in steps for k, w in enumerate(words)]
    return [*words, *[f"{a}-{b}" if k % 3 else a + b for k, (a, b) in enumerate(pairs)]]


def labelled_urls(spark: SparkSession, bad_steps: tuple[int, ...] = (1, 7), good_steps: tuple[int, ...] = (1, 7, 11)) -> DataFrame:
    """The small labelled table (url, label): stems of both kinds in the same hosts and paths, two of them a stem."""
    rows = []
    for bad, found in ((1.0, stems(BAD_WORDS, bad_steps)), (0.0, stems(GOOD_WORDS, good_steps))):
        for k, stem in enumerate(found):
            for j in (k, k + 3):
                rows.append(("http://" + LABEL_HOSTS[j % 6].format(stem) + LABEL_PATHS[(j + k) % 6], bad))
    return spark.createDataFrame(rows, "url string, label double")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host A-Z lower-cased; both empty for a null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    host, path = split_url(F.col("__u"))
    return df.withColumn("__u", F.col(url)).withColumns({"host": host, "path": path}).drop("__u")


def _grams(text: str, mark: str) -> Column:
    """All n-grams of a column with its ends marked; a look-ahead finds them in one pass over the text."""
    padded = F.concat(F.lit("^"), F.col(text), F.lit("$"))
    each = [F.transform(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(mark), g)) for n in GRAMS]
    return F.concat(*each)


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and the n-grams of both, marked by where they are from."""
    return with_parts(df, url).withColumn("grams", F.concat(_grams("host", "h"), _grams("path", "p")))


def train(labelled: DataFrame) -> PipelineModel:
    """Fit on (url, label). Rows without a label are left out; with one class only, that class is predicted; without any, all is allowed."""
    tf = HashingTF(inputCol="grams", outputCol="counts", numFeatures=BUCKETS, binary=True)
    lr = LogisticRegression(featuresCol="counts", labelCol="label", regParam=0.01, maxIter=25, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred")
    known = labelled.select("url", F.col("label").cast("double").alias("label")).filter("label is not null")
    if known.isEmpty():
        known = labelled.sparkSession.createDataFrame([("", 0.0)], "url string, label double")
    return Pipeline(stages=[tf, lr]).fit(features(known).coalesce(1))


def match_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    A rule is a host, from the first slash on followed by a path prefix; it fits
    its host and all subdomains; A-Z in it count as a-z, other letters as they
    are, and a rule without a host fits none. Of equally long ones the first in
    the list wins.
    """
    hits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at, slash, rest = rule.partition("/")
        at = at.translate(str.maketrans(UPPER, LOWER))
        if not at:
            continue
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        hits.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*hits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def rules_by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, hit) of the distinct hosts and paths that a rule (rule, verdict, rank) fits, however many rules there are.

    A host is looked up with each of its parent domains, so rules meet their
    hosts by equality. `rank` parts equally long rules: the least wins.
    """
    host, slash = F.substring_index("rule", "/", 1), F.instr("rule", "/")
    known = rules.select(ascii_lower(host).alias("__at"), F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("__prefix"), "rule", "verdict", "rank")
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = parts.select("host", "path").filter("host <> ''").distinct().withColumn("__at", F.explode(parents))
    fits = asked.join(known, "__at").filter(F.col("path").startswith(F.col("__prefix")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), -F.col("rank")))
    return fits.groupBy("host", "path").agg(best.alias("__hit"))


def judge(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str]], threshold: float = 0.5, key: str = "page_id") -> DataFrame:
    """Per page: host, path, the rule that applies or null, verdict allow or block, and the model's probability.

    A null URL or one without `://` has an empty host and path: no rule fits and
    the model's intercept decides. Every row is judged, repeated ones too; an
    empty table gives no rows, and a very long URL is judged as a whole.
    """
    scored = model.transform(features(pages.select(key, "url")))
    if len(rules) <= EXPRESSION_RULES:
        scored = scored.withColumn("__hit", match_rule(rules, F.col("host"), F.col("path")))
    else:
        table = pages.sparkSession.createDataFrame([(r, v, k) for k, (r, v) in enumerate(rules)], "rule string, verdict string, rank int")
        scored = scored.join(rules_by_join(with_parts(pages.select("url")), table), ["host", "path"], "left")
    p = vector_to_array("__p")[1]
    return scored.withColumn("p_block", p).select(key, "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce(F.col("__hit.verdict"), F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
