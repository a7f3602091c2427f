"""Secret scanning: candidate strings, and a random forest that removes the false ones, with DataFrame functions and MLlib.

Candidates are strings of letters and digits that hold a digit or that an assignment or a secret word announces. The forest sees a candidate's length, its character
classes and how often they change, how much of it common words cover, and what stands around it: the source, path
characters, and the neighbouring words. It is trained on labelled findings.
"""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from emberline.storage import materialize

# The forest is fitted on at most so many labelled findings, those with the smallest hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 30, 6, 17
MIN_LENGTH = 8
# A candidate's characters; how much of the words around a candidate's word is read.
RUN = f"[A-Za-z0-9+/_.@-]{{{MIN_LENGTH},}}"
NEAR = 200

# Common word parts of the corpus languages, words before a secret, words before harmless numbers.
COMMON = ("tion ment ing the and that with from ent ous able ure ion est ung lich keit heit ver sch ein der die das und "
          "que les des pour dans eau eur mente cion ado ido los las por para").split()
SECRET_WORDS = "token|secret|passw|passphrase|pwd|api|key|auth|credential|bearer|private"
HARMLESS_WORDS = "phone|tel|call|card|iban|mail|isbn|order|invoice|version|page"
# The same as whole words or parts of a name in snake or camel case, which let runs without a digit in.
SECRET_NAME = ("(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:tokens?|secrets?|passw(?:or[dt])?s?|passwd|passphrases?|pwd|api|api_?keys?|keys?|auth|"
               "credentials?|bearer|private)(?![a-z])")

FEATURES = ["length", "digits", "uppers", "lowers", "hex", "changes", "variety", "coverage", "quoted", "assigned", "secret_word",
            "harmless_word", "path", "address", "groups", "source_bucket"]


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, word (its place among the text's words), run (its place in the word), value, before (two
    words), lead (the run before it in its word and what stands between), tail (what follows up to the next run), after, source.

    Words stand between runs of ASCII white space. A candidate is any run of at least eight letters, digits and ``+/_.@-`` of a
    word that has a digit, or follows an assignment or a secret word. Null and empty texts have none. The words around a
    candidate are known by the ``NEAR`` characters next to its word, so that a word of very many runs stays linear.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    words = docs.select("doc_id", source.alias("source"), F.split(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), "[\\x20\\x09-\\x0D]+").alias("words"))
    own, last = lambda i: F.element_at("words", i), lambda i: F.element_at("words", F.greatest(i - 2, F.lit(1)))
    # The first word is the empty string, so the word before the first one is empty too.
    at = F.filter(F.sequence(F.lit(2), F.size("words") - 1), lambda i: (F.length(own(i)) >= MIN_LENGTH) & (
        own(i).rlike(f"[0-9=:]|{SECRET_NAME}") | own(i - 1).rlike(f"[=:]$|{SECRET_NAME}") | last(i).rlike(SECRET_NAME)))
    found = words.filter(F.size("words") > 2).select("doc_id", "source", F.explode(F.transform(at, lambda i: F.struct(
        (i - 2).cast("long").alias("word"), own(i).alias("own"),
        F.right(F.concat_ws(" ", F.when(i > 3, F.element_at("words", i - 2)), F.element_at("words", i - 1)), F.lit(NEAR)).alias("before"),
        F.left(F.element_at("words", i + 1), F.lit(NEAR)).alias("after")))).alias("c"))
    runs, gaps = F.regexp_extract_all("c.own", F.lit(f"({RUN})"), F.lit(1)), F.split("c.own", RUN, -1)
    pieces = F.arrays_zip(runs.alias("value"), F.concat(F.array(F.lit("")), runs).alias("prior"), gaps.alias("gap"),
                          F.slice(gaps, F.lit(2), F.size(gaps)).alias("tail"))
    found = found.select("doc_id", "source", "c.word", "c.before", "c.after", F.posexplode(pieces).alias("run", "p")).filter("p.value is not null")
    found = found.select("doc_id", "source", "word", F.col("run").cast("long").alias("run"), "before", F.concat("p.prior", "p.gap").alias("lead"),
                         F.col("p.value").alias("value"), F.col("p.tail").alias("tail"), "after")
    named = F.concat_ws(" ", "before", _name()).rlike(SECRET_NAME)
    return found.filter(F.col("value").rlike("[0-9]") | _assigned() | named)


def _name() -> Column:
    """What is assigned to in the candidate's own word: the field before the last ``=`` or ``:`` that no separator follows."""
    return F.regexp_extract("lead", "([^,;&]*)[=:][^,;&]*$", 1)


def _assigned() -> Column:
    inside = F.col("lead").rlike("[A-Za-z0-9_][^A-Za-z0-9,;&]*[=:][^,;&]*$")
    return inside | (~F.col("lead").rlike("[A-Za-z0-9]") & F.col("before").rlike("[=:]$"))


def _share(value: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kind}]", "")) / F.length(value)


def features(found: DataFrame) -> DataFrame:
    v, near = F.col("value"), F.concat_ws(" ", "before", _name())
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "9")
    runs = F.regexp_replace(classes, "(.)\\1+", "$1")
    return found.withColumns({
        "length": F.length(v).cast("double"), "digits": _share(v, "0-9"), "uppers": _share(v, "A-Z"), "lowers": _share(v, "a-z"),
        "hex": _share(v, "0-9a-f"), "changes": (F.length(runs) - 1) / F.length(v),
        "variety": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(COMMON), "")) / F.length(v),
        "quoted": F.concat("lead", "tail").rlike("[\"'`]").cast("double"),
        "assigned": _assigned().cast("double"),
        "secret_word": near.rlike(f"(?i)(?:{SECRET_WORDS})").cast("double"), "harmless_word": near.rlike(f"(?i)(?:{HARMLESS_WORDS})").cast("double"),
        "path": F.concat_ws(" ", "before", F.concat("lead", "value", "tail"), "after").rlike("[A-Za-z]/[A-Za-z]|\\.[a-z]{2,4}\\b").cast("double"),
        "address": v.contains("@").cast("double"), "groups": (F.size(F.split(v, "[-_./]")) - 1).cast("double"),
        "source_bucket": F.coalesce(F.pmod(F.xxhash64("source"), F.lit(8)), F.lit(0)).cast("double")})


def labelled(found: DataFrame) -> DataFrame:
    """Findings that their form decides, with ``label``: known key formats, assigned hexadecimal strings and strings without a
    digit that are assigned to a secret's name in one word are secrets; numbers, dates, addresses and strings that common words cover are none. Undecided ones are left out."""
    v = F.col("value")
    secret = v.rlike("^AKIA[0-9A-Z]{12,}$|^(?:ghp|sk|xoxb)[_-][A-Za-z0-9]{16,}$") | (v.rlike("^[0-9a-f]{12,}$") & v.rlike("[a-f]") & (F.col("assigned") > 0))
    secret = secret | (~v.rlike("[0-9]") & _name().rlike(SECRET_NAME))
    harmless = v.rlike("^[0-9./-]+$") | v.contains("@") | (F.col("coverage") >= 0.4)
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0)).filter("label is not null")


def train(findings: DataFrame, rows: int = TRAIN_ROWS):
    """A random forest fitted on at most ``rows`` labelled findings; None without findings of both labels."""
    order = F.xxhash64("doc_id", "word", "run", "value")
    sample = materialize(findings.select(*FEATURES, "label", order.alias("h")).orderBy("h", *FEATURES).limit(rows).coalesce(1), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def judge(found: DataFrame, model) -> DataFrame:
    """doc_id, word, run, value, score (the forest's share of votes for a secret), secret. Without a model scores are null and
    every candidate stays a finding."""
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word", "run", "value", "score", F.coalesce(F.col("score") >= 0.5, F.lit(True)).alias("secret"))


def scan(docs: DataFrame, learn_from: Column | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """All candidates of all documents, judged by a forest trained on the findings of ``learn_from`` (all documents).

    Null and empty texts give no row, repeated rows repeat their candidates, null ids and sources are allowed, an empty table
    gives an empty result. The value is shown by its first four characters, its length and its hash.
    """
    learn = docs if learn_from is None else docs.filter(learn_from)
    model = train(labelled(features(candidates(learn))), rows)
    out = judge(features(candidates(docs)), model)
    return out.select("doc_id", "word", "run", F.substring("value", 1, 4).alias("head"), F.length("value").cast("long").alias("length"),
                      F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret")
