"""Secret scan: a random forest that tells secrets from look-alikes, with DataFrame functions and spark.ml only.

Candidates are runs of key-like characters that prose does not have: with a
digit, of mixed case, unusually long, or given as the value of a telling name. The
forest judges each by its length, its changes between character classes, how much
of it dictionary words cover, the path it is from and the words beside it; it is
trained from labelled findings.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import LOWER, UPPER

#: The shortest run that is looked at.
MIN_LENGTH = 8
_RUN = f"[A-Za-z0-9_+/.@~-]{{{MIN_LENGTH},}}"
#: What prose hardly has: a digit or twenty letters in a row; in runs of MIXED_LENGTH, a capital after a small letter.
_ODD = "[0-9]|[A-Za-z]{20}"
MIXED_LENGTH = 16
#: What parts a name from its value inside a word.
_ASSIGN = "^[\\\\\"']*[:=]+[\\\\\"'(]*$"

#: Fragments of everyday words in the four languages.
WORDS = "the and for with that this from have your you are not ing tion ment able ness version release update image file table index user name mail example sample value test data default local host server client token secret password key der die das und ein ich nicht auf mit ung heit keit schaft que los las con por para cion mente ado les des une est pour dans avec eau aux ique January February March April June July August".lower().split()
KEYWORDS = "token|secret|passwor[dt]|passwd|pwd|api.?key|access.?key|private|credential|bearer|auth|client.?secret"
OTHERS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|revision|version|build|phone|call|tel|card|mail|address|order|invoice|isbn|example|sample|placeholder|dummy|test"
#: A telling name and the sign that gives it a value.
_NAMED = f"({KEYWORDS})[^=:]{{0,16}}[=:]|bearer |basic "
_VALUE = f"(({KEYWORDS})[^=:]{{0,16}}[=:][\\s\\\\\"'(]*|(bearer|basic) )$"
TEST_PATHS = "(^|[^a-z])(test|tests|spec|docs?|example|examples|fixture|sample|mock)([^a-z]|$)"

FEATURES = ("length", "changes", "digits", "hexes", "uppers", "signs", "distinct", "covered", "keyword", "other", "assigned", "test_path", "path_depth")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(doc_id, position, run, candidate, before, after, path) of each candidate; position is the number of its white-space word, run its place among the word's runs.

    A run of MIN_LENGTH key-like characters or more is a candidate if it has a
    digit, twenty letters in a row, or MIXED_LENGTH characters with a capital after a
    small letter, and any other one if it is the value of a telling name
    (`password=`, `api_key: `).
    `before` has what precedes the run in its own word, back to the run before
    it, and for the first run the two words before it too; a run that only an
    assignment parts from the next one is its name and belongs to its `before`.
    `after` is what stands up to the next run, after the last one the next word.
    Null and empty texts have none; a null path, or a table without one, has an empty path; repeated rows are
    looked at one by one, and an empty table gives no rows. The work is linear in a
    text's length, whatever the length of its words.
    """
    tokens = F.split("text", "\\s+")
    like = lambda c, pattern: F.regexp_like(c, F.lit(pattern))
    odd = lambda c: like(c, _ODD) | ((F.length(c) >= MIXED_LENGTH) & like(c, "[a-z][A-Z]"))

    def find(t: Column) -> Column:
        word = lambda i: F.get(t, i)
        near = lambda i: F.lower(F.concat_ws(" ", word(i - 2), word(i - 1), word(i)))
        hit = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (F.length(word(i)) >= MIN_LENGTH) & like(word(i), _RUN) & (odd(word(i)) | like(near(i), _NAMED)))
        return F.transform(hit, lambda i: F.struct(i.alias("position"), word(i).alias("own"), F.concat_ws(" ", word(i - 2), word(i - 1)).alias("words"), F.coalesce(word(i + 1), F.lit("")).alias("after")))

    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), "text").filter("text is not null")
    found = rows.select("doc_id", "path", F.explode(_let(tokens, find)).alias("c")).select("doc_id", "path", "c.*")

    def each(runs: Column, gaps: Column) -> Column:
        """The word's runs; gaps[i] stands before runs[i], so the work is linear in the word."""

        def one(i: Column) -> Column:
            gap = F.get(gaps, i)
            named = (i > 0) & like(gap, _ASSIGN)
            near = F.concat(F.when(named, F.get(runs, i - 1)).otherwise(F.lit("")), gap)
            before = F.when((i == 0) | ((i == 1) & named), F.concat_ws(" ", "words", F.when(i == 0, near).otherwise(F.concat(F.get(gaps, F.lit(0)), near)))).otherwise(near)
            after = F.when(i == F.size(runs) - 1, F.col("after")).otherwise(F.get(gaps, i + 1))
            return F.struct(i.alias("run"), F.get(runs, i).alias("candidate"), before.alias("before"), after.alias("after"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(runs) - 1), one), lambda c: odd(c["candidate"]) | like(F.lower(c["before"]), _VALUE))

    runs = _let(F.regexp_extract_all("own", F.lit(_RUN), F.lit(0)), lambda r: _let(F.split("own", _RUN), lambda g: each(r, g)))
    return found.select("doc_id", "position", "path", F.explode(runs).alias("r")).select("doc_id", "position", "r.run", "r.candidate", "r.before", "r.after", "path")


def features(found: DataFrame) -> DataFrame:
    """The numeric columns FEATURES from candidate, before, after and path; nulls count as empty."""
    text, before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in ("candidate", "before", "after", "path"))
    n = F.greatest(F.length(text), F.lit(1))
    classes = F.translate(text, LOWER + UPPER + string.digits, "a" * 26 + "A" * 26 + "9" * 10)
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    beside = F.lower(F.concat_ws(" ", before, after))
    new = {
        "length": F.log1p(F.length(text)),
        "changes": F.length(F.regexp_replace(classes, "(.)\\1+", "$1")) / n,
        "digits": share("[^0-9]"),
        "hexes": share("[^0-9a-fA-F]"),
        "uppers": share("[^A-Z]"),
        "signs": share("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(F.lower(text), ""))) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(text), "|".join(WORDS), "")) / n,
        "keyword": F.regexp_like(F.lower(before), F.lit(KEYWORDS)).cast("double"),
        "other": F.regexp_like(beside, F.lit(OTHERS)).cast("double"),
        "assigned": F.regexp_like(before, F.lit("[=:]\\s*[\"'(]*$")).cast("double"),
        "test_path": F.regexp_like(F.lower(path), F.lit(TEST_PATHS)).cast("double"),
        "path_depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
    }
    return found.withColumns({k: v.cast("double") for k, v in new.items()})


def labelled_findings(spark: SparkSession, n: int = 240, seed: str = "findings") -> DataFrame:
    """(candidate, before, after, path, label): n findings of each of two kinds, made by rule from digests of `seed`.

    Shapes and contexts are those of configuration files, source code and logs at
    large; a table of your own findings is better where there is one.
    """
    letters = string.ascii_letters + string.digits
    lead = ("export", "const", "with", "set", "", "use the", "env", "--")
    tail = ('"', "", "next", ";", "and", "'", "}", "for")
    paths = ("src/app/config.py", "deploy/env", "", "notes", "settings.yaml", "src/main/App.java")
    rows = []
    for k in range(n):
        h = hashlib.sha512(f"{seed}/yes/{k}".encode()).hexdigest()
        d = [int(h[2 * i : 2 * i + 2], 16) for i in range(64)]
        mixed = "".join(letters[x % 62] for x in d)
        value = (
            h[: 16 + k % 32],
            h[:40],
            mixed[: 20 + k % 30],
            mixed[:20].upper(),
            h[:40].upper(),
            "pre_" + mixed[:36],
            mixed[:12].translate(str.maketrans(string.digits, "kvxqzwjptr")),
            mixed[: 10 + k % 14].lower().translate(str.maketrans(string.digits, "kvxqzwjptr")),
            WORDS[d[0] % len(WORDS)] + WORDS[d[1] % len(WORDS)] + str(1000 + d[2]),
            mixed[:10] + "/" + mixed[10:22] + "+" + mixed[22:40],
        )[k % 10]
        name = ("token", "password", "secret", "api_key", "client_secret", "Authorization: Bearer", "PASSWORD", "db.passwd", "access-key", "auth_token", "private_key")[k // 2 % 11]
        join = (' = "', "=", ": ", '="', "=", '":"')[k // 3 % 6]
        rows.append((value, f"{lead[d[3] % 8]} {name}" + (" " if "Bearer" in name else join), tail[d[4] % 8], paths[d[5] % 6], 1.0))
    for k in range(n):
        h = hashlib.sha512(f"{seed}/no/{k}".encode()).hexdigest()
        d = [int(h[4 * i : 4 * i + 4], 16) for i in range(20)]
        word = lambda i, d=d: WORDS[d[i] % len(WORDS)]
        digits = "".join(str(x % 10) for x in d[:16])
        mail = f"{word(0)}.{d[1] % 100}@mail{d[2] % 9}.example.com"
        uuid = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"
        value, before = (
            (h[:40], "fixed in commit "),
            (mail, "write to "),
            (digits, "the card "),
            ("-".join(word(i) for i in range(4)) + str(d[5] % 100), "see the "),
            (".".join(str(x % 156 + 100) for x in d[:4]), "host at "),
            (uuid, "request uuid="),
            (h[:32], "md5: "),
            ("your-api-token-" + str(d[0] % 1000), "token = "),
            ("xxxxxxxxxxxx" + str(d[0] % 10), "password="),
            (digits[: 8 + k % 9], f"{word(3)} {word(4)} "),
            (mail, f"{word(3)} {word(4)} "),
            (f"/images/{word(1)}/{d[2] % 10000}.jpeg", "the "),
            (word(0) + word(1).title() + word(2).title() + word(3).title() + word(4).title(), ("return ", "call ", "")[k % 3]),
            (f"{1990 + d[0] % 40}-{d[1] % 12 + 1:02d}-{d[2] % 28 + 1:02d}", ("on ", "date: ", "of ")[k % 3]),
            (word(0) + word(1) + word(2) + word(3) + word(4) + word(5), f"{word(6)} "),
            (f"v{d[0] % 20}.{d[1] % 30}.{d[2] % 100}-beta", "version "),
            (("changeme", "required", "optional", "undefined", "disabled")[d[0] % 5], ("password: ", "token=", "auth: ", "api_key = ")[k % 4]),
            (digits[:10], ("call ", "tel: ", "order ", "invoice ")[k % 4]),
            (".".join(str(x % 156 + 100) for x in d[:4]), f"{word(5)} {word(6)} "),
            (f"{word(0)}/{word(1)}/{word(2)}_{d[3] % 100}.py", "in "),
        )[k % 20]
        rows.append((value, before, tail[d[6] % 8], (*paths[:4], "tests/fixture.py", "docs/example.md")[d[7] % 6], 0.0))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label double")


def train(labelled: DataFrame, trees: int = 40, depth: int = 8) -> PipelineModel:
    """Fit on labelled findings; rows without a label are left out.

    With one class only, every candidate gets that class; without any label
    nothing is a secret. Null columns of a finding count as empty.
    """
    known = labelled.filter("label is not null")
    if known.isEmpty():
        known = labelled.sparkSession.createDataFrame([("", "", "", "", 0.0)], "candidate string, before string, after string, path string, label double")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="__x"), forest]).fit(features(known).coalesce(1))


def scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5, path: str | None = "source") -> DataFrame:
    """(doc_id, position, run, length, candidate_sha256, p_secret, is_secret) of every candidate, secrets and look-alikes.

    No shuffle: each document is scanned where it is read. Findings carry a
    digest, never the secret. Null and empty texts give no rows; rows that repeat
    are scanned one by one; an empty table gives no rows.
    """
    scored = model.transform(features(candidates(docs, path)))
    p = F.coalesce(F.get(vector_to_array("__p"), 1), F.lit(0.0))  # a model of one class has no second one
    return scored.select("doc_id", "position", "run", F.length("candidate").cast("int").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), p.alias("p_secret"), (p >= threshold).alias("is_secret"))
