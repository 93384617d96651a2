"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary.

For each prefix of a unit the table keeps the one token with which the prefix's encoding ends. An
automaton over the vocabulary names the tokens that end at each place, longest first; the one that
stands is the first whose start is itself a prefix with a last token, and which stays apart from
that token when both are encoded together (pair compatibility). Ids are then read backwards from
the end of the unit. A unit is a run of word separators with what follows up to the next run: no
piece spans the end of one, so units are encoded apart and remembered.

Characters that the vocabulary lacks become byte pieces, which stay apart from everything.

Cases: null and empty texts give the end id alone, and decode to the empty text; repeated rows
each get a row; an empty table gives no rows; further columns are dropped; long texts are encoded
whole, in time linear in their length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BARRIER = -1
START = -2


@dataclass(frozen=True)
class Vocabulary:
    """Mergeable pieces with their scores by id, byte ids and the end id of a model file."""

    pieces: dict[int, str]
    scores: dict[int, float]
    byte_ids: tuple[int, ...]
    silent: frozenset[int]
    unknown: int
    end: int
    #: For each piece of several characters that its own text encodes to: the last merge that makes it.
    splits: dict[int, tuple[int, int]]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        proto = sentencepiece_model_pb2.ModelProto()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto.ParseFromString(model.serialized_model_proto())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm = proto.normalizer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        known = all(p.type in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in proto.pieces)
        merges = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        normal = {i: p.piece for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if not (plain and known and merges and proto.trainer_spec.byte_fallback) or any(SPACE in p.lstrip(SPACE) for p in normal.values()):
            raise ValueError(f"{path}: only BPE models with byte fallback, no normalisation and separators in front are supported")
        by_byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        return cls(
            normal,
            {i: proto.pieces[i].score for i in normal},
            tuple(by_byte[f"<0x{b:02X}>"] for b in range(256)),
            frozenset(i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL),
            next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN),
            model.eos_id(),
            {},
        )._with_splits()

    def _with_splits(self) -> Vocabulary:
        id_of = {p: i for i, p in self.pieces.items()}
        for i, p in self.pieces.items():
            parts = best_merges(p, id_of, self.scores, stop=2)
            if len(p) > 1 and len(parts) == 2:
                self.splits[i] = (id_of[parts[0]], id_of[parts[1]])
        return self


def best_merges(text: str, id_of: dict[str, int], scores: dict[int, float], stop: int = 1) -> list[str]:
    """Pieces of a short text of known characters: the best neighbours merge, leftmost first, down to ``stop`` pieces."""
    parts = list(text)
    while len(parts) > stop:
        best, at = None, -1
        for k in range(len(parts) - 1):
            i = id_of.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or scores[i] > best):
                best, at = scores[i], k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixEncoder:
    """Encodes and decodes; ``remembered`` bounds the units and pairs that are kept."""

    def __init__(self, vocab: Vocabulary, remembered: int = 400_000):
        self.vocab, self.remembered = vocab, remembered
        self.id_of = {p: i for i, p in vocab.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for i, p in vocab.pieces.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[str, float, float]]] = {}
        score = vocab.scores
        #: Pieces that score no worse than a part of theirs: for them the order of merges is played out.
        self.tied = {i for i, (a, b) in vocab.splits.items() if any(len(vocab.pieces[k]) > 1 and score[k] <= score[i] for k in (a, b))}
        while more := {i for i, (a, b) in vocab.splits.items() if i not in self.tied and (a in self.tied or b in self.tied)}:
            self.tied |= more
        self.size = {i: len(p) for i, p in vocab.pieces.items()}
        self.units: dict[str, bytes] = {}  # ids as an array's bytes: half the room of tuples
        self.older: dict[str, bytes] = {}
        self.shown = {i: p.replace(SPACE, " ").encode() for i, p in vocab.pieces.items()} | {i: bytes([b]) for b, i in enumerate(vocab.byte_ids)}
        self.shown |= dict.fromkeys(vocab.silent, b"") | {vocab.unknown: " ⁇ ".encode()}

    def edge(self, token: int, side: int) -> list[tuple[str, float, float]]:
        """The pieces that stand at one edge of ``token`` while it is merged, last first: text, score when made, score of the merge that takes it."""
        found, taken = [], -np.inf
        while True:
            split = self.vocab.splits.get(token)
            made = self.vocab.scores[token] if split else np.inf
            found.append((self.vocab.pieces[token], made, taken))
            if split is None:
                return found
            token, taken = split[side], made

    def apart(self, left: int, right: int) -> bool:
        """Whether ``left`` and then ``right`` stay as they are when encoded together.

        Merges are made by falling score. Going back from the two whole tokens, each pair of edge
        pieces that ever stand side by side is tried: it merges across if its piece scores above
        the merge that takes the left one (leftmost first on ties) and not below the one that
        takes the right one.
        """
        if right == BARRIER:
            return True
        key = left * 65536 + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.remembered:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        pieces, id_of, scores = self.vocab.pieces, self.id_of, self.vocab.scores
        if not self.whole(right):
            return False
        if left < 0:
            return True
        if left in self.tied or right in self.tied:
            return best_merges(pieces[left] + pieces[right], id_of, scores) == [pieces[left], pieces[right]]
        a = self.edges.get(left) or self.edges.setdefault(left, self.edge(left, 1))
        b = self.edges.get(~right) or self.edges.setdefault(~right, self.edge(right, 0))
        i = j = 0
        while True:
            (x, x_made, x_taken), (y, y_made, y_taken) = a[i], b[j]
            over = id_of.get(x + y)
            if over is not None and scores[over] > x_taken and scores[over] >= y_taken:
                return False
            if x_made < y_made:
                i += 1
            elif y_made < np.inf:
                j += 1
            else:
                return True

    def whole(self, token: int) -> bool:
        """Whether ``token`` is the encoding of its own text."""
        return token in self.vocab.splits or len(self.vocab.pieces[token]) == 1

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of one unit, by its prefix table."""
        n = len(text)
        last = [START] + [BARRIER] * n
        ended = 0
        size, pairs, apart = self.size, self.pairs, self.apart
        for at, token in self.automaton.iter(text):
            if at < ended:
                continue
            left = last[at + 1 - size[token]]
            fits = pairs.get(left * 65536 + token)
            if fits or (fits is None and apart(left, token)):
                ended = at + 1
                last[ended] = token
        ids, at = [], n
        while at:
            token = last[at]
            if token == BARRIER:
                ids += [self.vocab.byte_ids[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                ids.append(token)
                at -= size[token]
        return tuple(reversed(ids))

    def _remember(self, text: str) -> bytes:
        """Ids of a unit; when the newer half of what is kept is full, the older half goes."""
        ids = self.units.get(text) or self.older.get(text) or array("i", self.unit(text)).tobytes()
        if len(text) < 64:
            if len(self.units) >= self.remembered // 2:
                self.older, self.units = self.units, {}
            self.units[text] = ids
        return ids

    def encode(self, text: str | None) -> array:
        """Ids of a whole text, the end id last."""
        ids = array("i")
        if text:
            parts = UNITS.findall(SPACE + text.replace(" ", SPACE))
            found = list(map(self.units.get, parts))
            if None in found:
                found = [known or self._remember(p) for p, known in zip(parts, found, strict=True)]
            ids.frombytes(b"".join(found))
        ids.append(self.vocab.end)
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``: control ids are silent, and one leading separator goes."""
        shown = self.shown
        parts = [shown[i] for i in ids]
        if not self.vocab.silent.isdisjoint(ids[:-1]):
            return self._patched(ids, self._led(ids, parts))
        try:
            return b"".join(self._led(ids, parts)).decode()
        except UnicodeDecodeError:
            return self._patched(ids, parts)

    def _led(self, ids: Sequence[int], parts: list[bytes]) -> list[bytes]:
        """``parts`` without the separator that leads the text."""
        first = next((k for k, i in enumerate(ids) if i not in self.vocab.silent), None)
        if first is not None and parts[first][:1] == b" " and ids[first] in self.vocab.pieces:
            parts[first] = parts[first][1:]
        return parts

    def _patched(self, ids: Sequence[int], parts: list[bytes]) -> str:
        """As ``decode``, where byte pieces don't make characters: each such byte shows as U+FFFD."""
        out, run, known = [], b"", set(self.vocab.byte_ids)

        def flush(run: bytes) -> str:
            text = ""
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        text, run = text + run[:n].decode(), run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text, run = text + "�", run[1:]
            return text

        for i, p in zip(ids, parts, strict=True):
            if i in known:
                run += p
            else:
                out += [flush(run), p.decode()]
                run = b""
        return "".join([*out, flush(run)])


def _list_column(rows: list[array]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.frombuffer(b"".join(r.tobytes() for r in rows), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


#: By broadcast: a worker drops a broadcast at its first task without it, and the encoder, with all that it remembers, goes along.
_KEPT: WeakKeyDictionary[Broadcast, PrefixEncoder] = WeakKeyDictionary()


def _encoder(shared: Broadcast) -> PrefixEncoder:
    """One encoder for each Python worker, as long as its tasks use it."""
    if shared not in _KEPT:
        _KEPT[shared] = PrefixEncoder(shared.value)
    return _KEPT[shared]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id_col`` and ``ids`` array<int> of every whole text; with ``with_text`` also ``decoded``, read back from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # its size is the model's
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                rows = [encoder.encode(t) for t in batch.column("text").to_pylist()]
                columns, names = [batch.column("id"), _list_column(rows)], [id_col, "ids"]
                if with_text:
                    columns, names = [*columns, pa.array([encoder.decode(r) for r in rows], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * with_text)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` of rows with id lists; a null list decodes to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
