"""Byte-pair encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import query, table, text_of

#: Words of each of the two generations that a task remembers. Bounds memory only.
CACHE_WORDS = 60_000
_NO_RANK = np.int64(1) << 60


class WordBpe:
    """A vocabulary file of the kind: NFC, lower case, word pattern, byte symbols, end-of-word suffix."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        splitter = data["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(splitter["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        # longer strings first, so that none hides behind its own prefix
        names = sorted(self.special, key=lambda s: (-len(s), s))
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        # printable stand-ins of the 256 bytes: printable Latin-1 is itself, the others follow from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(plain)]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + self.suffix] for b in range(256)], np.int64)
        self.width = np.int64(size)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring symbols by binary search over the sorted pair keys."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NO_RANK)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), _NO_RANK)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            live = np.repeat(lowest < _NO_RANK, counts)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                lowest = np.repeat(lowest, counts)[live]
                symbols, owner, rank = symbols[live], owner[live], rank[live]
            else:
                lowest = np.repeat(lowest, counts)
            if not len(symbols):
                break
            at = np.flatnonzero((rank == lowest) & (rank < _NO_RANK))
            # of overlapping equal pairs (a a a) the first, third, ... are merged
            run = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            places = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at = places[at]
            # only pairs beside a merged symbol have a new rank
            beside = np.unique(np.r_[at, at[at > 0] - 1])
            tail = beside + 1 < len(symbols)
            rank[beside[~tail]] = _NO_RANK
            beside = beside[tail]
            same = owner[beside] == owner[beside + 1]
            rank[beside[~same]] = _NO_RANK
            beside = beside[same]
            rank[beside] = self._rank(symbols[beside], symbols[beside + 1])
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        packed = symbols[order].astype("<u4").tobytes()
        stops = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        starts = np.r_[0, stops[:-1]]
        return [packed[a:b] for a, b in zip(starts.tolist(), stops.tolist())]

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; strings of special tokens stay whole, marked by a leading NUL and NUL."""
        parts = self.split.split(text) if self.split and "<" in text else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append("\0\0" + part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                # lower case of each code point by itself, without the rule for a final sigma
                part = part.lower() if "Σ" not in part else "".join(
                    c.lower() for c in part)
                out.extend(self.words.findall(part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; words unknown to the task are merged together in one flat array.

        Words in use pass from the older generation of the memory to the recent one, so that common words are never
        merged again when a generation is full.
        """
        split = [self.pieces(t) for t in texts]
        if len(self.recent) > CACHE_WORDS:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        new = set(chain.from_iterable(split)).difference(recent)
        again = new.intersection(older)
        recent.update((w, older[w]) for w in again)
        new -= again
        marked = {w for w in new if w.startswith("\0\0") and w[2:] in self.special}
        plain = list(new - marked)
        if plain:
            recent.update(zip(plain, self.merge(plain)))
        for w in marked:
            recent[w] = int(self.special[w[2:]]).to_bytes(4, "little")
        return [b"".join(map(recent.__getitem__, words)) for words in split]


def token_texts(spec: str) -> list[str]:
    """Text of each id."""
    data = json.loads(spec)
    vocab = data["model"]["vocab"] | {t["content"]: t["id"] for t in data["added_tokens"]}
    tokens = [""] * (max(vocab.values()) + 1)
    for token, number in vocab.items():
        tokens[number] = token
    return tokens


def _texts_in_steps(column, step: int = 1000, most: int = 2 << 20):
    """Texts of an Arrow column in lists of bounded size."""
    texts, size = [], 0
    for value in column:
        text = value.as_py()
        texts.append(text)
        size += len(text)
        if len(texts) >= step or size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: id, ids BINARY (little-endian unsigned 32-bit), n_tokens.

    `vocabulary` is the path of a tokenizer file with a word pattern and an end-of-word suffix; the driver reads it once
    and the tasks get its content, whose size does not grow with the data. Null is the empty text and gives no ids.
    Rows are independent: repeated rows, null ids and extra columns do no harm, an empty table gives no rows.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        model = WordBpe(spec.value)
        for batch in batches:
            ids = [packed for texts in _texts_in_steps(batch.column("text")) for packed in model.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                ["id", "ids", "n_tokens"])

    return rows.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text: tokens joined by a space, special tokens included; no ids give the empty text."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(token_texts(file.read()))
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        text_of_id = spec.value.__getitem__
        for batch in batches:
            texts = pa.array([" ".join(map(text_of_id, np.frombuffer(v.as_py() or b"", "<u4").tolist()))
                              for v in batch.column(ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
