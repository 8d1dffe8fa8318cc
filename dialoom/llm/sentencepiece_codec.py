"""SentencePiece encoding and decoding by a batched numpy Viterbi.

All words of the same length advance together, one character a step. At each step the substrings that end there (as
hashes from prefix sums) probe the sorted keys of the pieces; each found piece gets a value and the vectorised maximum
over piece lengths is stored as the backpointer. Following the pointers back gives the pieces.

The value depends on the model's kind, which the model file states:

* unigram: the sum of piece scores up to the begin of the piece, plus its own; the usual Viterbi.
* BPE: byte-pair encodings have no additive score, but they have the same optimal substructure: the encoding
  of a prefix ends with the one piece that merging keeps apart from the last piece of the prefix before it.
  The value is 1 if this holds for the neighbouring pieces, else 0. Whether merging keeps two pieces apart is found
  by following, in merge order, the pieces at the seam: all pairs at a time, in numpy. So the result equals that
  of the model's own merge rules (tested against the sentencepiece library), which plain score sums would not.

A text becomes words at white space marks and at characters that no piece of several characters has; no piece
crosses these. Words seen before come from a bounded memo. Characters without a piece become byte pieces or <unk>.

Models with the identity normaliser and a dummy prefix, as the public one, are taken; others raise an error.

Defined cases: null and empty text have no pieces; decoding gives back the text (with U+2581 as a space, as the
format has it); very long words are encoded whole; repeated rows get equal answers; extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship

#: Where the public model lies; a parameter of every function that reads it.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MEMO_WORDS = 400_000
#: Texts are taken together up to about so many bytes, so that there are many words of each length.
BYTES_AT_A_TIME = 2_000_000
_NONE = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Codec:
    """Tables of one model, made on the driver and sent to the tasks: some MB for a vocabulary of 32,000."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool, unknown: int):
        self.bpe, self.unknown = bpe, unknown
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        texts = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        if any(SPACE in p.lstrip(SPACE) for p in texts):
            raise ValueError("pieces that cross white space are not supported")
        self.surface = [p.encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b"\xe2\x81\x87" if k == "unknown" else b"" for p, k in zip(pieces, kinds)]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.longest = max(map(len, texts))
        self.scores = np.array(scores, np.float64)
        # Merge order: better scores first, equal ones by id.
        order = np.lexsort((np.arange(len(pieces)), -self.scores))
        self.rank = np.empty(len(pieces), np.int64)
        self.rank[order] = np.arange(len(pieces))
        keys = np.array([_hash(p) for p in texts], np.uint64)
        ids = np.fromiter(texts.values(), np.int64)
        self.keys, self.ids = np.sort(keys), ids[np.argsort(keys)]
        # One bit of each key's high bits tells most substrings that are no piece before the sorted keys are searched.
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.powers = _powers(self.longest + 1)
        inner = {c for p in texts if len(p) > 1 for c in p} - {SPACE}
        if not inner <= texts.keys():
            raise ValueError("pieces with characters that are no pieces themselves are not supported")
        joined = "".join(map(re.escape, sorted(inner)))
        self.chunks = f"{SPACE}*[{joined}]+|{SPACE}+|[^{SPACE}{joined}]" if joined else f"{SPACE}+|[^{SPACE}]"
        self.memo: dict[str, bytes] = {}  # ids as int32
        if bpe:
            self._merges(texts)

    def _merges(self, texts: dict[str, int]) -> None:
        """How each piece comes about: its seams on either side, from the single character up to itself."""
        splits = {(texts[p[:i]], texts[p[i:]]): t for p, t in texts.items() for i in range(1, len(p)) if p[:i] in texts and p[i:] in texts}
        halves: dict[int, tuple[int, int]] = {}
        whole = np.zeros(len(self.rank), bool)
        for p, t in texts.items():
            parts = [texts[c] if c in texts else -1 for c in p]
            last = None
            while len(parts) > 1:
                found = [(self.rank[m], i, m) for i, two in enumerate(zip(parts, parts[1:])) if (m := splits.get(two)) is not None]
                if not found:
                    break
                _, i, m = min(found)
                last = parts[i], parts[i + 1]
                parts[i : i + 2] = [m]
            whole[t] = parts == [t]
            if whole[t] and last:
                halves[t] = last
        depth = self.longest + 1
        self.whole = whole
        self.right, self.left = np.full((len(self.rank), depth), -1, np.int64), np.full((len(self.rank), depth), -1, np.int64)
        for t in np.flatnonzero(whole):
            for table, side in ((self.right, 1), (self.left, 0)):
                seam = [int(t)]
                while seam[-1] in halves:
                    seam.append(halves[seam[-1]][side])
                table[t, : len(seam)] = seam[::-1]
        count = len(self.rank)
        pairs = np.array([a * count + b for a, b in splits], np.int64)
        at = np.argsort(pairs)
        self.pairs = pairs[at]
        self.pair_rank = self.rank[np.fromiter(splits.values(), np.int64)][at]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a and b, side by side, as they are."""
        two, back = np.unique(a * len(self.rank) + b, return_inverse=True)
        a, b = two // len(self.rank), two % len(self.rank)
        out, left = np.ones(len(two), bool), np.arange(len(two))
        i, j = np.zeros(len(two), np.int64), np.zeros(len(two), np.int64)
        while len(left):
            x, y = self.right[a, i], self.left[b, j]
            next_x, next_y = (np.where(t >= 0, self.rank[t], _NONE) for t in (self.right[a, i + 1], self.left[b, j + 1]))
            key = x * len(self.rank) + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            across = np.where(self.pairs[at] == key, self.pair_rank[at], _NONE)
            # Of equal merges the left one comes first.
            merged = (across < next_x) & (across <= next_y)
            out[left[merged]] = False
            on = ~merged & ((next_x < _NONE) | (next_y < _NONE))
            step = next_x <= next_y
            i, j, a, b, left = (i + step)[on], (j + ~step)[on], a[on], b[on], left[on]
        return out[back]

    def _viterbi(self, words: list[str]) -> np.ndarray:
        """Words of one length -> (words, length + 1) of the piece that ends at each place, -1 for none."""
        length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)
        prefix = np.zeros((len(words), length + 1), np.uint64)
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i] + np.uint64(1)
        best = np.full((len(words), length + 1), -np.inf)
        best[:, 0] = 0
        back = np.full((len(words), length + 1), -1, np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(1, min(self.longest, end) + 1)
            key = prefix[:, [end]] - prefix[:, end - sizes] * self.powers[sizes]
            key = _mixed(key, sizes.astype(np.uint64))
            piece = np.full(key.shape, -1, np.int64)
            maybe = np.nonzero(self.seen[(key >> np.uint64(42)).astype(np.int64)])
            asked = key[maybe]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            piece[maybe] = np.where(self.keys[at] == asked, self.ids[at], -1)
            if self.bpe:
                piece = np.where((piece >= 0) & self.whole[piece], piece, -1)
                before = back[:, end - sizes]
                value = np.where((piece >= 0) & (sizes == end), 1.0, -np.inf)
                seam = (piece >= 0) & (before >= 0)
                if seam.any():
                    value[seam] = np.where(self.apart(before[seam], piece[seam]), 1.0, -np.inf)
            else:
                value = np.where(piece >= 0, best[:, end - sizes] + self.scores[piece], -np.inf)
            choice = value.argmax(axis=1)
            rows = np.arange(len(words))
            best[:, end] = value[rows, choice]
            back[:, end] = np.where(np.isfinite(best[:, end]), piece[rows, choice], -1)
        return back

    def _followed(self, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follows the backpointers of all words at a time: the pieces of each word in order, and their numbers."""
        end = np.full(len(back), back.shape[1] - 1)
        steps = []
        while end.any():
            piece = np.where(end > 0, back[np.arange(len(back)), end], -1)
            if (piece[end > 0] < 0).any():
                raise ValueError("a word with a character that has no piece")
            steps.append(piece)
            end = end - np.where(piece >= 0, self.lengths[piece], 0)
        path = np.stack(steps[::-1], axis=1)
        there = path >= 0
        return path[there], there.sum(axis=1)

    def _fallback(self, char: str) -> tuple[int, ...]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if len(self.bytes) == 256 else (self.unknown,)

    def learn(self, words: set[str]) -> None:
        """Encodes words into the memo."""
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, own in by_length.items():
            step = max(1, 100_000 // length)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                if length == 1 and self._viterbi(part)[:, 1].min() < 0:  # characters without a piece stand alone
                    back = self._viterbi(part)[:, 1].tolist()
                    self.memo.update((w, np.array((p,) if p >= 0 else self._fallback(w), np.int32).tobytes()) for w, p in zip(part, back))
                    continue
                ids, counts = self._followed(self._viterbi(part))
                raw, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
                self.memo.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends], ends))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        chunks = re.compile(self.chunks)
        cut = [chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = {*chain.from_iterable(cut)}.difference(self.memo)
        if new:
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo.clear()
                new = {*chain.from_iterable(cut)}
            self.learn(new)
        memo = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(memo, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64))), dtype=np.uint64)


def _mixed(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(32))) + size * np.uint64(0xA0761D6478BD642F)


def _hash(piece: str) -> int:
    key = np.zeros(1, np.uint64)
    for c in piece:
        key = key * _BASE + np.uint64(ord(c) + 1)
    return int(_mixed(key, np.array([len(piece)], np.uint64))[0])


def load(path: str = MODEL_PATH) -> Codec:
    """Reads a model on the driver; executors need no file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    plain = model.normalizer_spec
    if plain.precompiled_charsmap or not plain.add_dummy_prefix or plain.remove_extra_whitespaces:
        raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
    kinds = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
    pieces = [p.piece for p in model.pieces]
    return Codec(pieces, [p.score for p in model.pieces], [kinds[p.type] for p in model.pieces], model.trainer_spec.model_type == 2, model.trainer_spec.unk_id)


def _added(df: DataFrame, fields: T.StructType, values: Callable[[pa.Array], list[pa.Array]], text: str) -> DataFrame:
    """df with columns computed from Arrow batches, cut so that a task holds about BYTES_AT_A_TIME of texts and their results."""
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in names]
    place = [f.name for f in df.schema].index(text)
    others = [i for i, f in enumerate(df.schema) if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
            part = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BYTES_AT_A_TIME
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    piece = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays(
                        [*[piece.column(i) for i in others], *values(piece.column(place))], names=[*[f.name for f in kept], *[f.name for f in fields]]
                    )

    return df.mapInArrow(run, T.StructType([*kept, *fields.fields]))


_IDS = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])


def _lists(ids: list[np.ndarray]) -> list[pa.Array]:
    counts = np.array([len(x) for x in ids], np.int64)
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))), pa.array(counts)]


def encode(docs: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """docs with ``token_ids`` and ``n_tokens`` (taken over if docs has them)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(codec)  # bounded by the vocabulary
    return _added(docs, _IDS, lambda texts: _lists(held.value.encode(texts.to_pylist())), text)


def decode(encoded: DataFrame, codec: Codec, ids: str = "token_ids") -> DataFrame:
    """encoded with ``decoded``, the text of its ids."""
    ship(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(codec)

    def texts(rows: pa.Array) -> list[pa.Array]:
        return [pa.array([held.value.decode(np.asarray(r or (), np.int64)) for r in rows.to_pylist()], pa.string())]

    return _added(encoded, T.StructType([T.StructField("decoded", T.StringType())]), texts, ids)


def round_trip(docs: DataFrame, codec: Codec, carried: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, token_ids, same, carried columns): ids of each text, and whether decoding them gives the text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(codec)

    def both(texts: pa.Array) -> list[pa.Array]:
        plain = texts.to_pylist()
        ids = held.value.encode(plain)
        same = [held.value.decode(i) == (t or "").replace(SPACE, " ") for i, t in zip(ids, plain)]
        return [*_lists(ids), pa.array(same)]

    fields = T.StructType([*_IDS.fields, T.StructField("same", T.BooleanType())])
    return _added(docs.select("doc_id", "text", *carried), fields, both, "text").select("doc_id", "n_tokens", "token_ids", "same", *carried)
