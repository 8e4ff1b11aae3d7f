"""Packing along a space-filling curve.

Each document becomes a hashed vector of token counts, projected to ``DIMS`` dimensions by a
fixed random matrix; every coordinate is cut into ``2^BITS`` cells and the Hilbert key of the
cell orders the documents.  A range sort by (key, doc_id) and its prefix sums of token counts
give every document its place in one stream, which is cut at every ``length`` tokens: neighbours
on the curve share sequences and only the last sequence has padding.

Defined cases: null or empty text is the end token alone; rows with one doc_id are documents
of their own (a row number tells them apart); documents longer than a sequence run on into the next;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import LOWER, byte_rows, lean_batches, only_cache, prefix_sums
from loadline.plans.staging import stage

DIMS, BITS, HASHED = 4, 8, 256
#: Type of ids by their bytes.
KINDS = {2: "<u2", 4: "<u4"}
END_ID = 1
#: Most entries of a worker's token cache, about 200 bytes each.
CACHE_PARTS = 600_000
#: Bytes of text that are tokenized at once, and ids whose keys are made at once.
GROUP_BYTES, GROUP_IDS = 1_000_000, 500_000


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows, dims), cells below 2^bits.

    The coordinates are brought to transposed Gray form from the highest bit down, then
    their bits are interleaved (Skilling, "Programming the Hilbert curve", 2004).
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = np.int64(1) << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


#: How the tokenizer splits lower-case text: contractions, runs of letters, single digits, runs of other signs.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
ASCII_PARTS = re.compile(CONTRACTIONS + r"|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
#: The same for texts of ISO 8859-1, whose letters, numbers and white space these are.
LATIN_PARTS = re.compile(CONTRACTIONS + "|[a-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t\n\x0b\x0c\r\x85\xa0a-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+")
PARTS = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


class WordTokens:
    """Token ids of UTF-8 texts as bytes, part by part.

    The tokenizer splits text into parts (``PARTS``) and encodes each on its own, so a text's ids
    are its parts' ids in order and each part is encoded once a worker.  New parts of letters of some texts are encoded
    together and cut where a token ends a part.  Texts with special tokens, or whose letters the tokenizer rewrites before it
    splits them, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for runs of letters between spaces, which need no other splitting, and of a to z, which need no mapping
        self.letters, self.plain = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        for name, probe in (("letters", "word größe ångström εύρηκα слово 言葉 naïve x Österreich"), ("plain", "a word of the tokenizer quizzically jvxq z")):
            if self.encoded(getattr(self, name), probe) != self.encoded(self.tokenizer, probe):
                setattr(self, name, self.tokenizer)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint32 if size > 1 << 16 else np.uint16
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    @staticmethod
    def encoded(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new parts, remembered as well."""
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        found = {p: self.alone(p) for p in new if not p.isalpha()}
        letters = [p for p in new if p not in found] if found else new
        self.learn_letters([p for p in letters if p.isascii()], self.plain, found)
        self.learn_letters([p for p in letters if not p.isascii()], self.letters, found)
        self.known.update(found)
        return found

    def learn_letters(self, letters: list[str], tokenizer, found: dict[str, bytes]) -> None:
        if not letters:
            return
        ids = np.array(self.encoded(tokenizer, " ".join(letters)), self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(letters):
            found.update([(p, self.alone(p)) for p in letters])
            return
        data, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
        found.update(zip(letters, [data[x:y] for x, y in zip([0, *cuts], cuts)]))

    def split(self, text: bytes) -> list[str] | None:
        """Parts of a text; None if it has to be encoded whole."""
        if b"<|" in text:
            return None
        if text.isascii():
            return ASCII_PARTS.findall(text.translate(LOWER).decode("ascii"))
        low = text.translate(LOWER).decode()
        try:
            low.encode("latin-1")
            return LATIN_PARTS.findall(low)
        except UnicodeEncodeError:
            pass
        if "\u0130" in low or not unicodedata.is_normalized("NFC", low):
            return None
        return PARTS.findall(low)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.split(x) for x in texts]
        parts = list(set().union(*[own for own in cut if own]))
        here = dict(zip(parts, map(self.known.get, parts)))  # small enough for a processor's cache
        new = list(compress(parts, map(is_, here.values(), repeat(None))))
        if new:
            here.update(self.learn(new))
        get = here.__getitem__
        return [b"".join(map(get, own)) if own is not None else self.alone(x.decode()) for x, own in zip(texts, cut)]


def some_texts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, about ``GROUP_BYTES`` at a time."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's tokenizer; a worker serves many tasks."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((HASHED, DIMS))


def curve_keys(packed: list[bytes], counts: np.ndarray, dtype, project: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents from their packed ids, some at a time."""
    keys = [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(packed):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(counts[lo:]), GROUP_IDS)) + lo)
        ids = np.frombuffer(b"".join(packed[lo:hi]), dtype).astype(np.uint32)
        hashed = (ids * np.uint32(2654435761)) >> np.uint32(24)
        place = np.repeat(np.arange(hi - lo, dtype=np.int64) * HASHED, counts[lo:hi]) + hashed
        vector = np.log1p(np.bincount(place, minlength=(hi - lo) * HASHED).reshape(-1, HASHED))
        points = vector @ project / np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
        cells = np.clip((np.tanh(points) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
        keys.append(hilbert_key(cells.astype(np.int64)))
        lo = hi
    return np.concatenate(keys)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, ids, n_tokens, key): ids are little-endian unsigned, 16 or 32 bit."""

    def run(batches):
        tokens, project = word_tokens(tokenizer_path), projection()
        only_cache(tokens.known)
        end = np.array([end_id], tokens.dtype).tobytes()
        for batch in batches:
            packed = [ids + end for some in some_texts([x or b"" for x in byte_rows(batch.column("text"))]) for ids in tokens(some)]
            counts = np.fromiter(map(len, packed), np.int64, len(packed)) // len(end)
            key = curve_keys(packed, counts, tokens.dtype, project)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(packed, pa.binary()), pa.array(counts), pa.array(key)],
                ["doc_id", "row", "ids", "n_tokens", "key"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, ids binary, n_tokens long, key long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), a row a piece; ids are little-endian unsigned 32-bit."""
    lean_batches(docs.sparkSession)
    rows = stage(tokenize(docs, tokenizer_path, end_id), "tokens")
    places = prefix_sums(rows.select("row", "doc_id", "n_tokens", "key"), ["key", "doc_id", "row"], "n_tokens", "place", name="curve")
    placed = rows.join(places.select(F.col("row").alias("_row"), "place"), F.col("row") == F.col("_row"))

    def cut(batches):
        only_cache({})
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, data, place, n in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(),
                                           batch.column("place").to_pylist(), batch.column("n_tokens").to_pylist()):
                data = np.frombuffer(data, KINDS[len(data) // n]).astype("<u4").tobytes()
                start = 0
                while start < n:
                    at = (place + start) % length
                    size = min(n - start, length - at)
                    for column, value in zip(out, (doc, start, size, data[4 * start:4 * (start + size)], n,
                                                   (place + start) // length, at)):
                        column.append(value)
                    start += size
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)],
                                             ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.select("doc_id", "ids", "n_tokens", "place").mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): the training sequences, the last one padded to ``length``."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"),
                                             F.sum("length").alias("n_tokens"))

    def join(batches):
        for batch in batches:
            whole = []
            for parts, n in zip(batch.column("p").to_pylist(), batch.column("n_tokens").to_pylist()):
                data = b"".join(x["ids"] for x in parts)
                ids = np.frombuffer(data, "<u4")
                whole.append(np.pad(ids.astype(np.int32), (0, length - n), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(whole, pa.list_(pa.int32())), batch.column("n_tokens")],
                                             ["sequence_id", "ids", "n_tokens"])

    return held.mapInArrow(join, "sequence_id long, ids array<int>, n_tokens long")
