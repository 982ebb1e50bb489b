"""Secrets in texts: candidates by their shape, false positives removed by a random forest.

The generators are wide: a run of at least twelve token characters that holds a digit, three or more
such runs joined by dots, and whatever stands after an assignment to a secret name. The forest sees a
candidate's length, how often the character class changes, how many of its characters belong to words
of the dictionary (the corpus' own most widespread words and a fixed list), whether it stands in a
path or an address, and the words beside it.

It is trained on labelled findings, rows of the same features with a label, 1 for a secret:

* made ones, whose label is known from how they were made (random keys, tokens and passwords, bare or
  assigned; digests, serials, names, paths, dates, placeholders and prose, bare or assigned too), so
  that neither a format nor an assignment settles the label;
* findings of all documents that speak for themselves (``weak_label``), shown without what spoke:
  an issued key without its prefix, an assigned value without the text before it. Findings that do not
  (``doubtful`` ones, and assigned digests, which nothing but the assignment marks) are judged, not learned from.

A bounded sample of each label is learned from. Its weight is evened out against the made ones, so few,
none or very many findings of one sort need no rule of their own. A candidate is kept if most trees
vote for it. Extraction, features and votes are SQL expressions inside the document's row.

Cases: a null text has no candidates; patterns run in linear time on texts of any length;
repeated rows get equal findings; without findings the made ones alone are learned from; an
empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from uuid import UUID

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import text_or_empty
from .spans import let, matches, replaced
from .trees import weighted_sum

TOKEN = "[A-Za-z0-9+/_-]"
#: Names that secrets are assigned to, formats of issued keys, words before digests and numbers, and fillers.
NAMES = "password|passwd|pwd|secret|token|credential|auth|api[_-]?key|access[_-]?key|private[_-]?key"
ISSUED = r"^(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35})$"
PREFIX = "^(?:AKIA|gh[opsu]_|xox[abprs]-|sk_live_|AIza)"
NUMBERED = r"commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid|id|serial|number|order|isbn|version|release|build|file|page|path|section|see"
FILLERS = "your|example|sample|dummy|change|placeholder|redacted|todo|here|none|null|xxx|\\*\\*\\*|\\.\\.\\."
ASSIGNED = rf"(?i)(?:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?$"
#: After an assignment; or runs joined by dots; or a run with a digit.
CANDIDATE = (
    rf"(?<=[\s=:\"'])(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"'<>,;]{{4,}}+"
    rf"|(?<!{TOKEN})(?:{TOKEN}{{12,}}+(?:\.{TOKEN}{{12,}}+){{2,}}+|(?=[A-Za-z+/_-]*+[0-9]){TOKEN}{{12,}}+={{0,2}}+)"
)
#: Words whose letters in a candidate speak against a secret, beside those of the corpus.
DICTIONARY = (
    "access account admin article build config content data default demo dev document download example file group home html http "
    "image index info item key line list local main name number page part path post production public readme release report "
    "sample server section service site source static system table test text title update user value version view with"
).split()
ENTROPY_CLASSES = ["[a-z]", "[A-Z]", "[0-9]", "[+/_=-]"]
#: Findings of each label that the forest learns from, about, chosen by a hash.
SAMPLE_FINDINGS = 20_000
#: Words of the corpus in the dictionary, and the share of documents that a word of it has at least.
DICTIONARY_WORDS, DICTIONARY_SHARE = 2_000, 1 / 2_000
#: Made findings of each sort.
MADE = 80
TREES, DEPTH = 25, 8
FEATURES = 22


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS, text: str = "text") -> list[str]:
    """The words of three to twenty letters that most documents have, and the fixed ones; counted over all documents."""
    spelled = F.filter(F.array_distinct(F.split(F.lower(text_or_empty(text)), "[^a-z]+")), lambda w: F.char_length(w).between(3, 20))
    each = docs.select(F.explode(spelled).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    widespread = each.where(F.col("n") >= max(2.0, docs.count() * DICTIONARY_SHARE))  # so few that one task can order them
    return sorted({r.word for r in widespread.orderBy(F.desc("n"), "word").limit(words).collect()} | set(DICTIONARY))


def candidates(text: Column) -> Column:
    return matches(text, CANDIDATE, "secret", 0, needs=f"[0-9]|(?i:{NAMES})[\"']?\\s{{0,2}}[=:]|{TOKEN}{{12}}\\.{TOKEN}{{12}}")


def weak_label(s: Column) -> Column:
    return s["value"].rlike(ISSUED) | (s["left"].rlike(ASSIGNED) & s["value"].rlike("[0-9]") & (F.char_length(s["value"]) >= 12))


def _changes(value: Column) -> Column:
    shape = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26)
    shape = F.translate(F.translate(shape, "abcdefghijklmnopqrstuvwxyz", "a" * 26), "0123456789", "0" * 10)
    return F.char_length(F.regexp_replace(F.regexp_replace(shape, r"(.)\1+", "$1"), "^.", ""))


def doubtful(s: Column) -> Column:
    """Neither a labelled secret nor plainly something else: an assigned value, or a run as mixed as random keys are."""
    mixed = (_changes(s["value"]) >= 0.35 * F.char_length(s["value"])) & ~s["value"].rlike("^[0-9a-f-]+$")
    return ~weak_label(s) & (mixed | s["left"].rlike(ASSIGNED))


def _shown(s: Column) -> Column:
    """A finding of the documents without what labelled it."""
    value = F.regexp_replace(s["value"], PREFIX, "")
    left = F.when(s["left"].rlike(ASSIGNED), "").otherwise(s["left"])
    return F.struct(value.alias("value"), left.alias("left"), s["right"].alias("right"))


def features(s: Column, words: Sequence[str] = ()) -> list[Column]:
    value = s["value"]
    length = F.greatest(F.char_length(value), F.lit(1))
    known = F.split(F.lit(" ".join(words or DICTIONARY)), " ")
    spelled = F.filter(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), lambda w: F.array_contains(known, F.lower(w)))
    covered = F.char_length(F.array_join(spelled, ""))
    classes = [F.char_length(F.regexp_replace(value, f"(?!{c}).", "")) / length for c in ENTROPY_CLASSES]
    letters = F.char_length(F.regexp_replace(value, "[^A-Za-z]", ""))
    vowels = F.char_length(F.regexp_replace(value, "[^AEIOUaeiou]", ""))
    distinct = F.size(F.array_distinct(F.split(value, ""))) / length
    before = F.lower(s["left"])
    return [
        F.coalesce(f.cast("double"), F.lit(0.0))
        for f in (
            length, _changes(value) / length, covered / length, distinct, *classes, vowels / F.greatest(letters, F.lit(1)),
            length - F.char_length(F.translate(value, "/", "")), value.rlike("^[0-9]+$"), value.rlike("^[0-9a-f]+=*$"), value.rlike("^[0-9a-fA-F]+(?:-[0-9a-fA-F]+)+$"),
            value.rlike("(?:[+_-].*){3}"), F.lower(value).rlike(FILLERS), s["left"].rlike(r"[=:]\s*[\"']?$"), s["left"].rlike("[\"']$"),
            s["left"].rlike("(?:://|[./\\\\])[^ ]*$"), s["right"].rlike(r"^[./:@][A-Za-z0-9]"), before.rlike(rf"(?:{NAMES})[^a-z0-9]*$"),
            before.rlike(rf"\b(?:{NUMBERED})[^a-z0-9]*$"), value.rlike(PREFIX),
        )
    ]


def _described(label: Column, weight: Column, s: Column, words: Sequence[str]) -> list[Column]:
    return [label.cast("double").alias("label"), weight.cast("double").alias("weight"), F.array(*features(s, words)).alias("f")]


def _spread(rows: DataFrame) -> DataFrame:
    return rows.select("label", "weight", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(FEATURES)])


def findings(docs: DataFrame, rows: int = SAMPLE_FINDINGS, id_column: str = "doc_id", words: Sequence[str] = ()) -> DataFrame:
    """(label, weight, f0, f1, ...): weakly labelled candidates of all documents, about so many of each label by a hash; a weight is how many one stands for."""
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("text"))
    found = texts.select("id", F.explode(candidates(F.col("text"))).alias("s")).where(~doubtful(F.col("s")))
    found = found.where(~(F.col("s.left").rlike(ASSIGNED) & F.col("s.value").rlike("^[0-9a-f]+$"))).withColumn("label", weak_label(F.col("s")).cast("double"))
    found = cut(found, "labelled")
    counts = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    stands_for = {label: max(1.0, counts.get(label, 0) / rows) for label in (0.0, 1.0)}
    weight = F.when(F.col("label") == 1, stands_for[1.0]).otherwise(stands_for[0.0])
    unit = F.shiftrightunsigned(F.xxhash64("id", "s.start", "s.value", "s.left"), 11) / float(1 << 53)
    sampled = found.withColumn("weight", weight).where(unit * F.col("weight") < 1).select("label", "weight", _shown(F.col("s")).alias("s"))
    return cut(_spread(sampled.select(*_described(F.col("label"), F.col("weight"), F.col("s"), words))), "findings")


def made(times: int = MADE, seed: int = 8) -> list[tuple[str, str, int]]:
    """(text, the finding in it, 1 if it was made as a secret): the label is known from the making, not read from the text."""
    draw = random.Random(seed)
    hexes, lower, upper, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda signs, *sizes: "".join(draw.choice(signs) for _ in range(draw.randint(min(sizes), max(sizes))))
    digest = lambda: some(hexes, size) if (size := draw.choice([32, 40, 64])) else ""
    word = lambda: draw.choice(DICTIONARY)
    name = lambda: draw.choice("password passwd pwd secret token api_key apikey access_key auth_token client_secret DB_PASSWORD".split())
    assign = lambda: name() + draw.choice([" = ", "=", ": ", ' = "', '="', ": '"])
    lead = lambda: draw.choice(["", "and ", "see ", "the ", "use ", "was ", "in ", f"{word()} "])
    mixed = lambda: some(lower + upper + digits, 16, 44) + draw.choice(digits)
    secrets = [
        lambda: (assign(), mixed()), lambda: (assign(), digest()), lambda: (assign(), some(lower + upper + digits + "+/", 20, 60) + "7="),
        lambda: (lead(), mixed()), lambda: (lead(), some(lower + digits, 20, 36) + "4"), lambda: (assign(), some(lower + digits, 12, 36) + "4"),
        lambda: (lead(), draw.choice(["ghp_", "gho_", "ghs_"]) + some(lower + upper + digits, 36) + "0"), lambda: (lead(), "AKIA" + some(upper + digits, 15) + "3"),
        lambda: (lead(), "sk_live_" + some(lower + upper + digits, 16, 24) + "1"), lambda: (lead(), "eyJ" + ".".join(some(lower + upper + digits + "_-", 18, 60) + "5" for _ in range(3))),
        lambda: (assign(), word() + some(digits, 1, 4) + draw.choice("!$@#%&")), lambda: (assign(), some(lower + upper + digits + "!$@#%&*", 8, 20)),
        lambda: (assign(), "".join(some(lower, 4, 8).capitalize() for _ in range(3))), lambda: (assign(), "".join(word().capitalize() for _ in range(3)) + some(digits, 0, 3)),
    ]
    others = [
        lambda: (draw.choice(["commit ", "sha256:", "md5 = ", "checksum: ", "digest ", "etag "]), digest()), lambda: (lead(), digest()),
        lambda: (draw.choice(["id ", "uuid: ", "", "see "]), str(UUID(int=draw.getrandbits(128)))), lambda: (lead(), some(digits, 14, 19)),
        lambda: (draw.choice(["number ", "order: ", "serial = ", "isbn "]), some(digits, 12, 19)), lambda: (lead(), f"{word()}-{word()}-20{some(digits, 2)}-{word()}"),
        lambda: (lead() + "src/", f"{word()}/{word()}{some(digits, 1, 8)}/{word()}"), lambda: (lead() + f"https://{word()}.example/", f"{word()}/{word()}{some(digits, 4, 8)}"),
        lambda: (lead(), f"{word()}/{word()}{some(digits, 1, 5)}x20{some(digits, 6)}/{word()}"), lambda: (lead(), f"{word()}{word()}{some(digits, 1, 5)}x20{some(digits, 6)}"),
        lambda: (lead(), f"{word()}_{word()}_{some(digits, 4, 8)}_{word()}"), lambda: (lead(), "".join(word().capitalize() for _ in range(3)) + some(digits, 1, 3) + "Item"),
        lambda: (draw.choice(["version = ", "release ", "file: ", "build: "]), f"{word()}-{some(digits, 1, 2)}-{some(digits, 1, 2)}-build{some(digits, 2, 4)}"),
        lambda: (lead(), f"20{some(digits, 2)}-{some(digits, 2)}-{some(digits, 2)}T{some(digits, 2)}-{some(digits, 2)}"), lambda: (assign(), draw.choice(["your_password_here1", "changeme", "example123", "xxxxxxxxxxxx", "********", "none", "null", "your-token-here", "redacted"])),
        lambda: (name() + ": ", word() + "s"), lambda: (name() + ": ", some(lower, 4, 9)),
    ]
    ends = [" now", ", or", ". So", ""]
    rows = []
    for label, sorts in ((1, secrets), (0, others)):
        for sort in sorts:
            for _ in range(times):
                before, value = sort()
                closing = before[-1] if before[-1:] in {'"', "'"} else ""
                rows.append((f"{before}{value}{closing}{draw.choice(ends)}", value, label))
    return rows


def _made_findings(spark, words: Sequence[str]) -> DataFrame:
    rows = spark.createDataFrame(made(), "text string, value string, label int").select("value", "label", F.explode(candidates(F.col("text"))).alias("s"))
    return _spread(rows.where(F.col("s.value").contains(F.col("value"))).select(*_described(F.col("label"), F.lit(1.0), F.col("s"), words)))


@dataclass(frozen=True)
class Model:
    """A forest and the words of its dictionary."""

    forest: object
    words: tuple[str, ...]


def fit(labelled: DataFrame, words: Sequence[str] = ()) -> Model:
    """A forest fitted on (label, f0, f1, ...), with a weight or without, and on the made findings; each label of the former weighs as much as the latter at most."""
    columns = [f"f{i}" for i in range(FEATURES)]
    if "weight" not in labelled.columns:
        labelled = labelled.withColumn("weight", F.lit(1.0))
    own = cut(_made_findings(labelled.sparkSession, words), "made")
    most = own.count() / 2
    sums = {r.label: r.w for r in labelled.groupBy(F.col("label").cast("double").alias("label")).agg(F.sum("weight").alias("w")).collect()}  # two rows
    share = F.when(F.col("label") == 1, min(1.0, most / max(1.0, sums.get(1.0, 0.0)))).otherwise(min(1.0, most / max(1.0, sums.get(0.0, 0.0))))
    evened = labelled.select(F.col("label").cast("double").alias("label"), (F.col("weight") * share).alias("weight"), *columns).unionByName(own)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(evened.coalesce(4)).select("features", "label", "weight")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, weightCol="weight", featureSubsetStrategy="0.5").fit(vectors)
    return Model(forest, tuple(words))


def votes(model: Model, s: Column) -> Column:
    """Share of the trees that call a candidate a secret."""
    forest = model.forest
    return let(F.array(*features(s, model.words)), lambda f: weighted_sum(forest, lambda i: F.get(f, F.lit(i))) / len(forest.treeWeights))


def found(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` packed as ``row``, with body, n_candidates and the spans that most trees call secrets."""
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(text).alias("body"))
    judged = let(candidates(F.col("body")), lambda c: F.struct(F.size(c).cast("bigint").alias("n"), F.filter(c, lambda s: votes(model, s) > 0.5).alias("spans")))
    rows = body.select("row", "body", judged.alias("x"))
    return rows.select("row", "body", F.col("x.n").alias("n_candidates"), F.col("x.spans").alias("spans"))


def redacted(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs`` with every secret replaced by [SECRET]; a null text stays null."""
    rows = found(docs, model)
    text = F.when(F.col("row.text").isNotNull(), replaced(F.col("body"), F.col("spans"), lambda s: F.lit("[SECRET]")))
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
