"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The vocabulary and scores come from a SentencePiece model file. A text is normalised as these files ask (a space before it,
spaces become U+2581) and cut before each run of spaces; no piece crosses such a cut, so words are searched one by one and
each distinct word once. Words of equal length advance together: prefix hashes give the hash of every substring of a
length, a binary search in that length's sorted piece keys gives its score, and the best score at each end, longest piece
first, stores a backpointer. A character without a piece becomes its UTF-8 bytes (byte fallback) or the unknown id.

The ids are those of the unigram algorithm over the file's pieces and scores (the sequence of pieces with the largest sum).
For a file of model type BPE, whose scores are merge ranks, the library merges instead and gives other ids for nearly every
document; both decode to the same text. A file that asks for a normaliser, or for pieces, that this search doesn't know raises.

Defined cases: null or empty text has no ids; a null id is carried along; repeated rows are encoded one by one; further
columns are kept as they are, whatever their names; U+2581 in a text is read as a space, as the library does."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import append, free_name, slices, table, with_fields

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 19
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


def wire_fields(raw: bytes) -> dict[int, list]:
    """Fields of a protocol-buffer message: numbers of varints, bytes of the others."""
    out: dict[int, list] = {}
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, i = raw[i : i + size], i + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def check_settings(raw: bytes) -> str:
    """"unigram" or "bpe" of a model file's bytes. Raises where the file asks for a normaliser or pieces this search doesn't know.

    Numbers of fields and enums are fixed values of the public model format."""
    model = wire_fields(raw)
    trainer, normal = (wire_fields(model.get(n, [b""])[0]) for n in (2, 3))
    first = lambda fields, n, default: fields.get(n, [default])[0]
    kind = {1: "unigram", 2: "bpe"}.get(first(trainer, 3, 1))
    if kind is None:
        raise ValueError("the model is neither of type unigram nor BPE")
    if first(trainer, 24, 0):
        raise ValueError("pieces that end with white space aren't supported")
    if first(normal, 2, b"") or first(normal, 6, b""):
        raise ValueError("normalisation rules aren't supported: the file must keep characters as they are")
    if not first(normal, 3, 1) or first(normal, 4, 1) or not first(normal, 5, 1):
        raise ValueError("the file must add a space before a text, keep runs of spaces, and escape spaces")
    if any(first(wire_fields(piece), 3, 1) == 4 for piece in model.get(1, [])):
        raise ValueError("user-defined pieces aren't supported")
    return kind


class Vocabulary:
    """Pieces by length: sorted hashes, scores and ids. `kind`: what the file's own algorithm is, "unigram" or "bpe"."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = check_settings(sp.serialized_model_proto())
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece goes across a word's start")
        self.penalty = min((scores[i] for i in normal if scores[i] > -1e8), default=0.0) - 10.0
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(self.longest + 1):
            own = [i for i in normal if len(self.pieces[i]) == size and size]
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in own], dtype=np.uint64).reshape(len(own), size)
            keys = np.zeros(len(own), dtype=np.uint64)
            for c in codes.T:
                keys = keys * _BASE + c + np.uint64(1)
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("two pieces have one hash")
            self.tables.append((keys[order], np.array([scores[i] for i in own])[order], np.array(own, dtype=np.int64)[order]))
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], dtype=np.uint64)
        raw = lambda i: bytes([int(self.pieces[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else self.pieces[i].replace(SPACE, " ").encode()
        self.raw = [raw(i) for i in range(n)]

    def _group(self, words: list[str], size: int) -> list[list[int]]:
        """Best ids of words that all have `size` characters; a negative entry is -1 - code point of a character without piece."""
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(n, size)
        prefix = np.zeros((n, size + 1), dtype=np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * _BASE + codes[:, j] + np.uint64(1)
        longest = min(size, self.longest)
        score, ids = [None] * (longest + 1), [None] * (longest + 1)
        for k in range(1, longest + 1):
            keys, scores, own = self.tables[k]
            if not len(keys):
                continue
            h = prefix[:, k:] - prefix[:, : size + 1 - k] * self.powers[k]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            score[k], ids[k] = np.where(hit, scores[at], -np.inf), np.where(hit, own[at], -1)
        if score[1] is None:
            score[1], ids[1] = np.full((n, size), -np.inf), np.full((n, size), -1)
        bare = ids[1] < 0
        score[1] = np.where(bare, self.penalty, score[1])
        ids[1] = np.where(bare, -1 - codes.astype(np.int64), ids[1])
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), dtype=np.int64)
        for j in range(1, size + 1):
            top, step = np.full(n, -np.inf), np.ones(n, dtype=np.int64)
            for k in range(min(j, longest), 0, -1):
                if score[k] is None:
                    continue
                s = best[:, j - k] + score[k][:, j - k]
                better = s > top
                top = np.where(better, s, top)
                step[better] = k
            best[:, j], back[:, j] = top, step
        at = np.full(n, size)
        rows = np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            k = back[rows, at[rows]]
            at[rows] -= k
            own = np.empty(len(rows), dtype=np.int64)
            for length in np.unique(k).tolist():
                m = k == length
                own[m] = ids[length][rows[m], at[rows[m]]]
            found.append((rows, own))
            rows = rows[at[rows] > 0]
        out: list[list[int]] = [[] for _ in range(n)]
        for rows, own in reversed(found):
            for i, x in zip(rows.tolist(), own.tolist()):
                out[i].append(x)
        return out

    def slow(self, word: str) -> list[int]:
        """The same search by plain loops over the pieces themselves."""
        if not hasattr(self, "by_piece"):
            self.by_piece = {self.pieces[i]: (s, i) for _, scores, own in self.tables for s, i in zip(scores.tolist(), own.tolist())}
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for j in range(1, len(word) + 1):
            top = (-np.inf, 0, 0)
            for i in range(max(0, j - self.longest), j):
                s = self.by_piece.get(word[i:j], (self.penalty, -1 - ord(word[i])) if j - i == 1 else None)
                if s and best[i][0] + s[0] > top[0]:
                    top = (best[i][0] + s[0], i, s[1])
            best.append(top)
        out, j = [], len(word)
        while j:
            out.append(best[j][2])
            j = best[j][1]
        return out[::-1]

    def _bytes(self, x: int) -> list[int]:
        own = chr(-1 - x).encode()
        return [self.byte[b] for b in own] if all(b in self.byte for b in own) else [self.unknown]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words; each starts with a space mark."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        by_size.pop(0, None)
        pieces = self.pieces
        for size, own in by_size.items():
            step = max(1, _CELLS // size)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                for i, ids in zip(part, self._group([words[i] for i in part], size)):
                    if min(ids) < 0 or "".join([pieces[x] for x in ids]) != words[i]:
                        text = "".join(pieces[x] if x >= 0 else chr(-1 - x) for x in ids)
                        ids = ids if text == words[i] else self.slow(words[i])  # another text with the hash of a piece
                        ids = [y for x in ids for y in ([x] if x >= 0 else self._bytes(x))]
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids))
        return text.removeprefix(b" ").decode("utf-8", "replace")


class Memo:
    """Ids of texts; once the remembered words take about `most_bytes`, all are forgotten."""

    def __init__(self, path: str, most_bytes: int = 128 << 20):
        self.vocabulary, self.most_bytes = Vocabulary(path), most_bytes
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.pool = np.zeros(1 << 12, dtype=np.int32)
        self.starts, self.sizes, self.exact = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=bool)
        self.words = self.used = self.chars = 0

    def _learn(self, new: list[str]) -> None:
        """Remember words: their ids, and whether these decode to the word. Buffers double when they are full."""
        ids = self.vocabulary.encode_words([SPACE + w for w in new])
        size = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter((y for x in ids for y in x), dtype=np.int32, count=int(size.sum()))
        raw = self.vocabulary.raw
        same = [b"".join(map(raw.__getitem__, x)) == b" " + w.replace(SPACE, " ").encode() for x, w in zip(ids, new)]
        n, m = self.words + len(new), self.used + len(flat)
        grown = lambda x, used, need: x if need <= len(x) else np.concatenate([x[:used], np.zeros(max(need, 2 * len(x)) - used, dtype=x.dtype)])
        self.starts, self.sizes, self.exact = (grown(x, self.words, n) for x in (self.starts, self.sizes, self.exact))
        self.pool = grown(self.pool, self.used, m)
        self.at.update(zip(new, range(self.words, n)))
        self.starts[self.words : n], self.sizes[self.words : n], self.exact[self.words : n] = self.used + np.cumsum(size) - size, size, same
        self.pool[self.used : m] = flat
        self.words, self.used, self.chars = n, m, self.chars + sum(map(len, new))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a string array's texts one after another, the offsets of the texts, and whether each decodes to its text."""
        if self.words * 160 + self.chars + 4 * self.used > self.most_bytes:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(texts, " ")  # words without the space mark that each starts with
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | \\z|{SPACE}"), pc.equal(texts, ""))
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        usual = lists.filter(pc.invert(odd)).flatten().dictionary_encode()
        distinct = usual.dictionary.to_numpy(zero_copy_only=False).tolist()
        at_odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        own_odd = [[u[1:] for u in _UNITS(SPACE + t.replace(" ", SPACE))] if t else [] for t in (texts[int(i)].as_py() for i in at_odd)]
        counts[at_odd] = [len(x) for x in own_odd]
        missing = [w for w in dict.fromkeys([*distinct, *(w for x in own_odd for w in x)]) if w not in self.at]
        if missing:
            self._learn(missing)
        stops = np.cumsum(counts)
        index = np.empty(int(stops[-1]) if len(stops) else 0, dtype=np.int64)
        place = np.ones(len(index), dtype=bool)
        for i, own in zip(at_odd, own_odd):
            a = stops[i] - counts[i]
            index[a : stops[i]] = [self.at[w] for w in own]
            place[a : stops[i]] = False
        index[place] = np.fromiter((self.at[w] for w in distinct), dtype=np.int64, count=len(distinct))[usual.indices.to_numpy()]
        size = self.sizes[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(self.starts[index] - ends[:-1], size) + np.arange(ends[-1])]
        wrong = np.concatenate([[0], np.cumsum(~self.exact[index])])
        bounds = np.concatenate([[0], stops]).astype(np.int64)
        return flat, ends[bounds], wrong[bounds[1:]] == wrong[bounds[:-1]]


_MEMOS: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", name: str = "ids", exact: str | None = None) -> tuple[DataFrame, str]:
    """docs with a column of ids (array<int>), and its name. exact: a further boolean column, whether decoding gives the text."""
    name = free_name(docs, name)
    more = [(name, T.ArrayType(T.IntegerType()))] + ([(exact, T.BooleanType())] if exact else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = memo(path)
        for batch in slices(batches, text_col):
            flat, at, same = own.encode(batch.column(batch.schema.get_field_index(text_col)))
            fields = [pa.field(name, pa.list_(pa.int32()))]
            arrays = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))]
            if exact:
                fields.append(pa.field(exact, pa.bool_()))
                arrays.append(pa.array(same))
            yield append(batch, fields, arrays)

    return docs.mapInArrow(run, with_fields(docs.schema, *more)), name


def decode(rows: DataFrame, path: str, ids_col: str = "ids", name: str = "text") -> tuple[DataFrame, str]:
    """rows with a column of decoded texts (null ids: null), and its name."""
    name = free_name(rows, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = memo(path).vocabulary
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield append(batch, [pa.field(name, pa.string())], [pa.array([None if x is None else vocabulary.decode(x) for x in own], pa.string())])

    return rows.mapInArrow(run, with_fields(rows.schema, (name, T.StringType()))), name


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), exact="exact")
    return out.select("doc_id", F.size(name).cast("long").alias("n_ids"), F.col(name).alias("ids"), "exact")
