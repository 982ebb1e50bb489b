"""SentencePiece encoding and decoding, for byte-pair models with byte fallback.

Merging any two neighbours that form a piece, best score first and leftmost of equals, ends
in one sequence of pieces for each text. A sequence is that one exactly when every two
neighbours in it stay apart if merged alone: merges on both sides of a boundary come in the
same order whatever else the text holds, so the first merge across it would come in the pair
as well. So each prefix of a text has a unique last piece: of the pieces that end there, the
one that stays apart from the last piece of the prefix before it. One pass fills the table
of last pieces from the matches of an automaton; the ids are read off backwards.

Texts are cut where no piece has the two characters side by side, which no merge can cross;
what lies between two cuts is encoded once by a worker and kept, up to a bound. The model is
read on the driver and broadcast: it is of a fixed size.

Cases: a null text counts as empty and has no ids; characters without a piece become the
bytes of their UTF-8; texts of any length are encoded part by part; ids that are no whole
character decode to a replacement character for each byte, as the library does; repeated
rows are encoded alike; an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The mark of a space, and what stands for the unknown piece in a decoded text.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Parts that a worker keeps, as many again of those before them, and tested pairs; longer parts are not kept.
KEPT, KEPT_PAIRS, LONGEST_KEPT = 200_000, 300_000, 40
#: Signs at which words are cut at once where the pieces allow it.
SIGNS = ".,;:!?)\"'\n"
#: A text that a model must leave as it is but for spaces and the space before it.
PLAIN = "Ａ ﬁ é  İ\tx½"


@dataclass
class Model:
    """What a model file says, by id: pieces, scores, and the ids of normal pieces, bytes, control marks and the unknown one."""

    pieces: list[str]
    scores: list[float]
    normal: list[int]
    bytes: list[int]
    control: list[int]
    unknown: int
    key: str


def read_model(model_file: str) -> Model:
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=model_file)
    ids = range(lib.get_piece_size())
    kinds = {k: [i for i in ids if getattr(lib, f"is_{k}")(i)] for k in ("byte", "control", "unused", "unknown")}
    special = {i for k in kinds.values() for i in k}
    if len(kinds["byte"]) != 256 or kinds["unused"]:
        raise ValueError("a byte-pair model with byte fallback and without unused pieces is needed")
    if lib.normalize(PLAIN) != SPACE + PLAIN.replace(" ", SPACE):
        raise ValueError("a model that leaves texts as they are is needed")
    return Model(
        [lib.id_to_piece(i) for i in ids], [lib.get_score(i) for i in ids], [i for i in ids if i not in special],
        kinds["byte"], kinds["control"], lib.unk_id(), hashlib.sha256(lib.serialized_model_proto()).hexdigest(),
    )


codecs.register_error("each byte", lambda error: ("�", error.start + 1))


class Encoder:
    """A model with its automaton, and the tests and parts that a worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self.rank = {model.pieces[i]: model.scores[i] for i in model.normal}
        self.id = {model.pieces[i]: i for i in model.normal}
        self.bytes = model.bytes
        self.matches = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.matches.add_word(piece, (len(piece), i))
        self.matches.make_automaton()
        #: Characters that stand side by side in some piece; between any other two a text may be cut.
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.words = all(SPACE not in p.lstrip(SPACE) for p in self.id)
        # a word ends before signs that no piece has after any but signs
        signs = set(SIGNS)
        while bad := {pair[1] for pair in self.joined if pair[1] in signs and pair[0] not in signs}:
            signs -= bad
        to_sign = f"{SPACE}*[^{SPACE}{re.escape(''.join(sorted(signs)))}]+|"
        self.word = re.compile(f"{to_sign}{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        #: For each piece, whether the pieces met after it stay apart from it.
        self.pairs: list[dict[int, bool]] = [{} for _ in model.pieces]
        self.tested = 0
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        surface = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for i in model.control:
            surface[i] = b""
        for at, i in enumerate(model.bytes):
            surface[i] = bytes([at])
        surface[model.unknown] = UNKNOWN.encode()
        self.surface = surface
        self.silent = set(model.control)
        self.normal = set(model.normal)

    def formed(self, token: int) -> list[tuple[float, str, str]]:
        """How a piece is merged from its characters: after each step, the score of the next one and the symbols at both ends."""
        found = self.steps.get(token)
        if found is not None:
            return found
        symbols, found = list(self.model.pieces[token]), []
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.rank.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            found.append((best, symbols[0], symbols[-1]))
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        self.steps[token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary when the two pieces are merged from their characters together."""
        a, b, i, j = self.formed(left), self.formed(right), 0, 0
        while True:
            (next_a, _, end), (next_b, start, _) = a[i], b[j]
            across = self.rank.get(end + start)
            if across is not None and (next_a is None or across > next_a) and (next_b is None or across >= next_b):
                answer = False
                break
            if next_a is None and next_b is None:
                answer = True
                break
            if next_b is None or (next_a is not None and next_a >= next_b):
                i += 1
            else:
                j += 1
        if self.tested >= KEPT_PAIRS:
            for row in self.pairs:
                row.clear()
            self.tested = 0
        self.tested += 1
        self.pairs[left][right] = answer
        return answer

    def last_pieces(self, part: str) -> list[int]:
        """The unique last piece of every prefix of a part, by its length; all its characters have pieces."""
        last = [-1] * (len(part) + 1)
        after: list[dict[int, bool] | None] = [None] * (len(part) + 1)
        pairs, apart = self.pairs, self.apart
        for end, (length, token) in self.matches.iter(part):
            end += 1
            if after[end] is not None:
                continue
            at = end - length
            if at:
                row = after[at]
                if row is None:
                    continue
                answer = row.get(token)
                if answer is None:
                    answer = apart(last[at], token)
                if not answer:
                    continue
            last[end] = token
            after[end] = pairs[token]
        return last

    def _part(self, part: str) -> bytes:
        """Ids, four bytes each, of a part without cuts inside."""
        if len(part) == 1 and part not in self.id:
            ids = [self.bytes[b] for b in part.encode()]
        else:
            last, ids, at, pieces = self.last_pieces(part), [], len(part), self.model.pieces
            while at:
                ids.append(last[at])
                at -= len(pieces[last[at]])
            ids.reverse()
        return array("i", ids).tobytes()

    def _found(self, part: str) -> bytes:
        """Ids of a part that is not among the newest kept ones."""
        found = self.older.get(part)
        if found is None:
            joined = self.joined
            cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in joined]
            if cuts:
                found = b"".join([self.kept.get(x) or self._found(x) for x in [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]])
            else:
                found = self._part(part)
        if len(part) <= LONGEST_KEPT:
            if len(self.kept) >= KEPT:
                self.older, self.kept = self.kept, {}
            self.kept[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        words = self.word.findall(marked) if self.words else [marked]
        return b"".join([self.kept.get(word) or self._found(word) for word in words])

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        start = next((n for n, i in enumerate(ids) if i not in self.silent), len(ids))
        strip = start < len(ids) and ids[start] in self.normal and self.model.pieces[ids[start]].startswith(SPACE)
        runs, run = [], []
        if self.silent.isdisjoint(ids):
            runs = [b"".join([surface[i] for i in ids])]
        else:
            for i in ids:
                if i in self.silent:  # bytes on both sides of a control mark are not one character
                    runs.append(b"".join(run))
                    run = []
                else:
                    run.append(surface[i])
            runs.append(b"".join(run))
        text = "".join(r.decode("utf-8", "each byte") for r in runs)
        return text[1:] if strip else text


_loaded: dict[str, Encoder] = {}


def _encoder(model) -> Encoder:
    """One for each worker process and model; what it keeps lives as long as the worker."""
    key = model.value.key
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(model.value)
        gc.freeze()  # the model stays; the collector need not walk it again and again
    return _loaded[key]


def encoded(spark: SparkSession, text: Column, model_file: str) -> Column:
    """The ids of a text, without marks for its begin and end."""
    model = spark.sparkContext.broadcast(read_model(model_file))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        ids, ends = bytearray(), [0]
        for text in texts:
            ids += encoder.encode(text.as_py() or "")
            ends.append(len(ids) // 4)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, "<i4")))

    return encode(text)


def decoded(spark: SparkSession, ids: Column, model_file: str) -> Column:
    """The text of a list of ids."""
    model = spark.sparkContext.broadcast(read_model(model_file))

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return pa.array((encoder.decode(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends)), pa.string())

    return decode(_given(ids))


def digest(ids: Column) -> Column:
    """SHA-256, in lower-case hex, of the ids written in decimal with commas between them."""

    @F.arrow_udf("string")
    def hashed(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        texts = (",".join(map(str, flat[a:b].tolist())) for a, b in zip([0, *ends[:-1]], ends))
        return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())

    return hashed(_given(ids))


def _given(ids: Column) -> Column:
    """No ids for a null. Without an expression between them, ids that several functions take would be computed for each."""
    return F.coalesce(ids, F.array().cast("array<int>"))
