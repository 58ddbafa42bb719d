"""Byte-level BPE: texts to ids and back, over Arrow batches.

The tokenizers library does the merges. It knows characters only, so the byte
alphabet maps every byte to a printable character, and vocabulary, merges and what
is merged are written in those. They are built from a file of ranks (one token in base64 and
its rank a line): a token of several bytes is made by the merge of the two
tokens that lower ranks leave of it. A match of the split pattern that is itself
a token is taken whole, as the rank format means it.

Ids give byte spans (a running sum of token lengths) and spans of code points.
Where a character is divided between tokens, each of them spans the whole
character. Decoding looks bytes up in the ids' byte table; a character divided
between tokens is whole again when their bytes are joined, and bytes that are no
UTF-8 (ids cut within a character) become U+FFFD in the text, never in the bytes.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import table

#: Code points of texts encoded at once, about; longer texts are divided between two matches of the pattern.
PIECE = 1 << 18


def byte_alphabet() -> list[str]:
    """Of every byte its character: itself where that is printable, else the next free one from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in keep else free))
        free += b not in keep
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank. Ranks must be 0, 1, 2, ... and hold all single bytes."""
    with open(path, "rb") as f:
        rows = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    tokens = [t for _, t in rows]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError(f"{path}: not all bytes are tokens")
    return tokens


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """In rank order, the two tokens that make each token of several bytes.

    They are what merging by lower ranks leaves of it. A token that lower ranks
    do not bring down to two has no merge: it only stands for a whole match.
    """
    rank, out = {t: r for r, t in enumerate(tokens)}, []
    for r, t in enumerate(tokens):
        if len(t) < 2:
            continue
        parts = [t[i:i + 1] for i in range(len(t))]
        while len(parts) > 2:
            best, at = min((rank.get(parts[i] + parts[i + 1], r), i) for i in range(len(parts) - 1))
            if best >= r:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def build(tokens: list[bytes], pattern: str) -> str:
    """The tokenizer as JSON, to be sent to the workers: its size is that of the vocabulary."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    face = byte_alphabet()

    def text(t: bytes) -> str:
        return "".join(face[b] for b in t)

    tok = Tokenizer(models.BPE(vocab={text(t): r for r, t in enumerate(tokens)},
                               merges=[(text(a), text(b)) for a, b in merges_of(tokens)], ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"),
                                                 pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok.to_str()


@lru_cache(maxsize=2)
def _load(made: str) -> tuple:
    """Tokenizer, and of every id its bytes and their number."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"          # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(made)
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    by_id = sorted((i, bytes(byte[c] for c in t)) for t, i in tok.get_vocab(with_added_tokens=False).items())
    held = np.empty(len(by_id), dtype=object)
    held[:] = [t for _, t in by_id]
    return tok, held, np.array([len(t) for _, t in by_id], dtype=np.int64)


#: White space of the split pattern.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a text may be divided: white space behind something else. No match of the pattern goes over such a place and
#: none looks back, so the pieces give the ids of the whole.
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: Latin letters, general punctuation and currency signs: of these the regex package and the tokenizers library know
#: the same letters, digits and spaces (a test holds them against each other); elsewhere their Unicode versions differ.
_COMMON = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` code points, cut only between two matches."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Ids of texts.

    A piece of common characters is split by the regex package, and each distinct
    match goes to the library's model once, in byte characters; other pieces go
    to the library whole, which splits them itself. What is kept of matches has a
    bound; beyond it the lookup starts anew, which changes no id.
    """

    def __init__(self, tok, pattern: str, most: int = 32 * PIECE):
        import regex

        self.tok, self.most, self.held, self.known = tok, most, 0, {}
        self.split, self.model = regex.compile(pattern).findall, tok.model
        self.face = dict(enumerate(byte_alphabet()))

    def _learn(self, match: str) -> None:
        tokens = self.model.tokenize(match.encode().decode("latin-1").translate(self.face))
        self.known[match] = np.array([t.id for t in tokens], dtype=np.int32).tobytes()
        self.held += len(match) + 16

    def _piece(self, piece: str) -> bytes:
        if not _COMMON.fullmatch(piece):
            found = self.tok.encode_batch_fast([piece], add_special_tokens=False)[0]
            return np.array(found.ids, dtype=np.int32).tobytes()
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        matches = self.split(piece)
        for m in set(matches):
            if m not in self.known:
                self._learn(m)
        return b"".join(map(self.known.__getitem__, matches))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._piece, pieces(text))), dtype=np.int32)


def spans(text: str, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token its span in UTF-8 bytes and in code points (of characters it holds a byte of): starts, ends, starts, ends."""
    end = np.cumsum(size[ids])
    start = end - size[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)                  # of every byte, its character's number from 1
    return start, end, char[start] - 1, char[end - 1]


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    bounds = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, kind), *rows]).astype(kind)))


_SPANS = ("byte_start", "byte_end", "char_start", "char_end")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids), with ``offsets`` also (byte_start, byte_end, char_start, char_end): one list entry per token.

    ``ranks_path`` is read on the driver; its vocabulary bounds what is sent to
    the workers. Null texts are empty and have no ids. Every row gives one row,
    repeated ids too, a null id stays null. Other columns are not read.
    """
    spark = docs.sparkSession
    made = spark.sparkContext.broadcast(build(read_ranks(ranks_path), pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _, size = _load(made.value)
        encoder = Encoder(tok, pattern)
        for b in batches:
            for part in _slices(b, "text"):
                texts = part.column("text").to_pylist()
                ids = [encoder.ids(t) for t in texts]
                cols, names = [part.column("id"), _lists(ids, np.int32)], ["id", "ids"]
                if offsets:
                    found = [spans(t, i, size) for t, i in zip(texts, ids)]
                    cols += [_lists([f[k] for f in found], np.int64) for k in range(4)]
                    names += _SPANS
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = rows.schema["id"].dataType.simpleString()
    more = "".join(f", {s} array<long>" for s in _SPANS) if offsets else ""
    return rows.mapInArrow(run, f"id {kind}, ids array<int>{more}").withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch, col: str, most: int = 16 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose ``col`` holds about ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    length = pc.list_value_length if pa.types.is_list(batch.schema.field(col).type) else pc.binary_length
    size = np.cumsum(length(batch.column(col)).to_numpy(zero_copy_only=False))
    cut = np.flatnonzero(np.diff(size // most, prepend=0)) + 1
    bounds = [0, *[c for c in cut.tolist() if c < batch.num_rows], batch.num_rows]
    for i, j in zip(bounds, bounds[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def decode(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes, text): what the ids stand for. Null ids are empty; an unknown id is an error.

    ``bytes`` are exact for any ids; ``text`` has U+FFFD where they are no UTF-8.
    """
    spark = coded.sparkSession
    made = spark.sparkContext.broadcast(build(read_ranks(ranks_path), pattern))
    rows = coded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, held, _ = _load(made.value)
        for b in batches:
            for part in _slices(b, "ids", PIECE):
                column = part.column("ids")
                ids = column.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(held)):
                    raise ValueError("an id is not in the vocabulary")
                parts, at = held[ids].tolist(), np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))].tolist()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([b"".join(parts[i:j]) for i, j in zip(at, at[1:])], pa.binary())], ["id", "bytes"])

    kind = rows.schema["id"].dataType.simpleString()
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    return rows.mapInArrow(run, f"id {kind}, bytes binary").withColumn("text", text).withColumnRenamed("id", id_col)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    coded = encode(table(spark, sf_dir, "documents"), path, pattern)
    # the ids stay beside the id through decoding, so the two need no join
    both = decode(coded.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256")).alias("row"), "ids"),
                  path, pattern, id_col="row")
    return both.select("row.doc_id", "row.n_tokens", "row.ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
