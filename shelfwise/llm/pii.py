"""Personal data in texts: base formats, and spans that boosted trees add to them.

High-recall generators propose spans that may overlap each other and the base formats. Each
candidate is described by its format (length, digits, signs, check digit) and its context
(characters beside it, words before it). Gradient-boosted trees learn which of them
``evidence`` calls personal data: a sound format of its kind, and a context where the format
alone says little. It holds for candidates in base spans and elsewhere. They learn from three
quarters of all candidates of all documents, and the threshold of each kind, which a candidate's
probability must reach, is calibrated on the other quarter, all of it. Candidates with the same
features and label are one row with their number as its weight, so what is shuffled and fitted
are the different ones. Extraction, features and trees are SQL expressions inside the document's row.

Cases: a null text has no spans; patterns run in linear time on texts of any length;
repeated rows get equal spans; made candidates of every kind are learned from beside those found;
an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import text_or_empty
from .spans import in_order, let, listed, masked, matches, replaced
from .trees import weighted_sum

KINDS = ["email", "ip", "card", "phone"]
#: Base formats. A match cannot start inside a run that was just refused, which keeps the search linear.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a base format; cheaper to find than the format.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Generators of candidates, several for some kinds, each with what a text must have for it.
PROPOSED = {
    "email": [
        (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++", "@"),
        (
            rf"(?:\G|(?<!{LOCAL})){LOCAL}++ ?[\[(](?:at|AT|@)[\])] ?{LABEL}++(?:(?:\.| ?[\[(](?:dot|DOT|\.)[\])] ?){LABEL}++)++",
            r"[\[(](?:at|AT|@)[\])]",
        ),
    ],
    "ip": [
        (r"(?<![0-9A-Fa-f:.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}", r"[0-9]\.[0-9]"),
        (r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){4,7}+", "[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    ],
    "card": [(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2,3}+(?:[\x20-]?[0-9]{1,3}+)?+(?![0-9])", "[0-9]{4}")],
    "phone": [
        (
            r"(?<![0-9])\(?[0-9]{2,4}+[)./\x20-]{1,2}+[0-9]{2,4}+[\x20./-][0-9]{2,5}+(?:[\x20./-][0-9]{2,5}+)?+(?![0-9])",
            r"[0-9]{2}[)./\x20-]",
        )
    ],
}
#: Words before a candidate that speak for a kind; fixed values.
HINTS = ["mail|contact|write to", "host|server|address|login from", "card|visa|credit|payment", "phone|call|tel|fax|mobile", "version|license|section|no\\."]
ROUNDS, DEPTH, PRECISION = 16, 3, 0.999


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """For up to 20 digits: every second from the right is doubled, and the sum of digits ends in 0."""
    padded = F.lpad(digits, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(1, 21):
        total = total + F.substring(doubled if i % 2 else padded, i, 1).cast("int")
    return total % 10 == 0


def sound(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern passes the checks of its kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = digits_of(value)
        return F.char_length(digits).between(14, 19) & passes_luhn(F.substring(digits, 1, 20))
    if kind == "phone":
        return F.char_length(digits_of(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted spans of the base formats."""

    def of(order: int, kind: str) -> Column:
        return F.filter(matches(text, BASE[kind], kind, order, needs=NEEDS[kind]), lambda s: sound(kind, s["value"]))

    return in_order(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def candidates(text: Column) -> Column:
    """Spans of the generators; they may overlap."""
    return F.concat(*[matches(text, pattern, k, i, needs=needs) for i, k in enumerate(KINDS) for pattern, needs in PROPOSED[k]])


def without_base(text: Column) -> Column:
    """The text with base spans turned into NUL characters, so that few candidates meet one."""
    for kind in KINDS:
        text = masked(text, BASE[kind], _sound(kind))
    return text


def _sound(kind: str) -> Callable[[Column], Column]:
    return lambda value: sound(kind, value)


def _hinted(s: Column, hint: int) -> Column:
    return F.lower(s["left"]).rlike(f"(?:{HINTS[hint]})[^a-z]*$")


def well_formed(s: Column) -> Column:
    """Whether a candidate has a sound format of its kind and does not go on beside it."""
    value, digits = s["value"], digits_of(s["value"])
    part, group = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])", "[0-9A-Fa-f]{1,4}"
    plain = s["right"].rlike(r"^\.[A-Za-z0-9-]")
    written_out = value.rlike(r"[\[(](?:at|AT|@)[\])].*[A-Za-z]{2,}$")
    shortened = value.contains("::") & ~value.rlike("::.*::") & value.rlike(f"^{group}(?:::?{group}){{1,6}}$")
    address = value.rlike(rf"^{part}(?:\.{part}){{3}}$") | value.rlike(f"^{group}(?::{group}){{7}}$") | shortened
    date = value.rlike(r"^(?:[12][0-9]{3}[./ -][0-9]{2}[./ -][0-9]{2}|[0-9]{2}[./ -][0-9]{2}[./ -][12][0-9]{3})$")
    return (
        F.when(s["kind"] == "email", plain | written_out)
        .when(s["kind"] == "ip", address & ~s["right"].rlike("^(?:[A-Za-z0-9:]|[.][0-9])"))
        .when(s["kind"] == "card", F.char_length(digits).between(14, 19) & passes_luhn(F.substring(digits, 1, 20)))
        .otherwise(F.char_length(digits).between(7, 15) & ~date & ~s["right"].rlike("^(?:[A-Za-z0-9]|[./-][0-9])"))
    )


def evidence(s: Column) -> Column:
    """Whether format and context speak for a candidate; a phone number needs a country code, an area code in brackets or a word before it."""
    said = s["left"].rlike(r"\+[0-9]{0,3}[\x20.(-]{0,2}$") | s["value"].rlike("^[(][0-9]+[)]") | _hinted(s, 3)
    return well_formed(s) & F.when(s["kind"] == "phone", said & ~_hinted(s, 4)).otherwise(~_hinted(s, 4) | (s["kind"] != "ip"))


def features(s: Column) -> list[Column]:
    value = s["value"]
    digits = digits_of(value)
    length = F.char_length(value)
    before = F.lower(s["left"])
    flags = [
        s["order"], length, F.char_length(digits), F.char_length(F.regexp_replace(value, "[^A-Za-z]", "")),
        F.char_length(F.regexp_replace(value, r"[^\x20()./\[\]-]", "")), F.char_length(F.regexp_replace(value, "[^:]", "")),
        F.char_length(F.regexp_replace(value, "[^.]", "")), passes_luhn(F.substring(digits, 1, 20)), value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"),
        value.rlike("[(]"), s["left"].rlike("[A-Za-z0-9]$"), s["right"].rlike("^[A-Za-z0-9]"), s["right"].rlike("^[.:/-][A-Za-z0-9]"),
        well_formed(s), s["left"].rlike(r"\+[0-9]{0,3}[\x20.(-]{0,2}$"), value.rlike("^[(][0-9]+[)]"),
        *[before.rlike(f"(?:{words})[^a-z]*$") for words in HINTS],
    ]
    return [F.coalesce(f.cast("double"), F.lit(0.0)) for f in flags]


FEATURES = 16 + len(HINTS)


@dataclass
class Model:
    """Boosted trees and a threshold for each kind."""

    trees: object
    thresholds: list[float]

    def probability(self, s: Column) -> Column:
        values = F.array(*features(s))
        return let(values, lambda f: 1 / (1 + F.exp(-2 * weighted_sum(self.trees, lambda i: F.get(f, F.lit(i))))))

    def accepts(self, s: Column) -> Column:
        return self.probability(s) >= F.get(F.array(*[F.lit(t).cast("double") for t in self.thresholds]), s["order"])


def _described(rows: DataFrame) -> DataFrame:
    """(order, label, fold, weight, f0, f1, ...) of candidates ``s`` by ``id``: equal ones are one row, whose weight is their number."""
    fold = F.when(F.pmod(F.xxhash64("id", "s.start"), F.lit(4)) == 0, 0).otherwise(1).alias("fold")
    each = rows.select(F.col("s.order").alias("order"), evidence(F.col("s")).cast("double").alias("label"), fold, F.array(*features(F.col("s"))).alias("f"))
    grouped = each.groupBy("order", "label", "fold", "f").agg(F.count("*").cast("double").alias("weight"))
    return grouped.select("order", "label", "fold", "weight", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(FEATURES)])


def proposals(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(order, label, fold, weight, f0, f1, ...) of every candidate of all documents; a weight is how many candidates one row stands for."""
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("text"))
    return cut(_described(texts.select("id", F.explode(candidates(F.col("text"))).alias("s"))), "candidates")


def starters() -> list[str]:
    """Made texts with candidates of every kind and label, learned from with those of the documents, however few these are."""
    texts = []
    for k in range(24):
        number = f"4111{k * 7919 % 10000:04d}{k * 104729 % 10000:04d}{k * 31 % 1000:03d}"
        doubled = [int(d) * (2 - i % 2) for i, d in enumerate(number)]
        check = -sum(d - 9 * (d > 9) for d in doubled) % 10
        texts += [
            f"write to joe{k} [at] mail{k} [dot] com today", f"or ann.{k} (at) host (dot) org", f"user{k}@localhost ran", f"job{k} [at] {k} [dot] 5 x",
            f"see 2001:0db8:85a3:0000:0000:8a2e:0370:{k:04x} now", f"host 2001:db8::{k + 1:x} answers", f"device 00:1a:2b:3c:4d:{k:02x} is up",
            f"at 300.1.{k}.1 or version 10 20 30 {k}", f"release {k}.4.17.2 of it", f"seen 10.1.2.{k} and a{k}@b.co and +1 (988) 555-{2400 + k}",
            f"call (0{10 + k}) 7946 09{k:02d} now", f"phone: 555 1{k:02d} 45{k:02d}, or", f"order 555 1{k:02d} 45{k:02d} came", f"on 20{k:02d} 11 {k + 1:02d} and",
            f"paid by {number}{check} then", f"number {number}{(check + 1 + k % 8) % 10} fails", f"card {number[:4]} {number[4:8]} {number[8:12]} {number[12:]}{check} ok",
        ]
    return texts


def _started(found: DataFrame) -> DataFrame:
    """``found`` with the starters' candidates."""
    made = found.sparkSession.createDataFrame([(-i, t) for i, t in enumerate(starters())], "id bigint, text string")
    described = _described(made.select("id", F.explode(candidates(F.col("text"))).alias("s")))
    return cut(found.select(*described.columns).unionByName(described), "candidates")


def fit(found: DataFrame) -> Model:
    """Learns from all folds but 0, and sets each kind's threshold on fold 0: the lowest, from 0.5, at which what passes is right often enough.

    The starters are among the candidates, so there is one rule for any number of them.
    """
    columns = [f"f{i}" for i in range(FEATURES)]
    found = _started(found)
    learned = found.where("fold <> 0")
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(learned).select("features", "label", "weight")
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=7, weightCol="weight").fit(vectors)
    model = Model(trees, [])
    p = 1 / (1 + F.exp(-2 * weighted_sum(trees, lambda i: F.col(f"f{i}"))))
    held = found.where("fold = 0").groupBy("order", F.ceil(p * 100).alias("bin")).agg(F.sum(F.col("label") * F.col("weight")).alias("true"), F.sum("weight").alias("n")).collect()
    for order in range(len(KINDS)):
        right = total = 0.0
        best = 1.0
        for r in sorted((r for r in held if r.order == order), key=lambda r: -r.bin):  # 101 bins at most
            right, total = right + r.true, total + r.n
            if right / total >= PRECISION:
                best = max(0.5, (r.bin - 1) / 100)
        model.thresholds.append(best)
    return model


def selected(text: Column, base: Column, model: Model) -> Column:
    """Candidates outside base spans that the model accepts, sorted."""
    touches = lambda s: F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    bare = F.when(F.size(base) > 0, without_base(text)).otherwise(text)
    return let(bare, lambda t: in_order(F.filter(candidates(t), lambda s: ~touches(s) & model.accepts(s))))


def found(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` packed as ``row``, with arrays base and spans (base and added ones, sorted) and the text as ``body``."""
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(text).alias("body"))
    based = body.select("row", let(F.col("body"), lambda t: let(base_spans(t), lambda b: F.struct(t.alias("body"), b.alias("base"), selected(t, b, model).alias("added")))).alias("x"))
    return based.select("row", F.col("x.body").alias("body"), F.col("x.base").alias("base"), in_order(F.concat("x.base", "x.added")).alias("spans"))


def redacted(docs: DataFrame, model: Model, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; a null text stays null."""
    mark = mark or (lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rows = found(docs, model)
    text = F.when(F.col("row.text").isNotNull(), replaced(F.col("body"), F.col("spans"), mark))
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


__all__ = ["KINDS", "Model", "base_spans", "candidates", "count_of", "fit", "found", "listed", "proposals", "redacted"]
