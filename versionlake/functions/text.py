"""Text expressions and the few text helpers that need Python."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# Separators in the order they are tried, chunk size in characters, minimum words of a chunk.
CHUNK_SEPARATORS = ("\n\n", "\n", " ", "")
CHUNK_SIZE = 200
MIN_WORDS = 4
REPEAT_THRESHOLD = 3
JOIN_MARK = "\n\n"
QUERY_TASK = "Retrieve semantically similar text."

SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
TOKEN_PATTERN = "(?U)\\b\\w\\w+\\b"
JAVA_META = re.compile(r"([\\.\[\]{}()*+\-?^$|&#~<>=!:])")


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def remove_phrases(c: Column, phrases: list[str]) -> Column:
    """Drop whole-word, case-insensitive occurrences of each phrase, then strip. A phrase that ends in a
    full stop is only found when a word character follows it, as the word boundary asks."""
    for phrase in phrases:
        pattern = JAVA_META.sub(r"\\\1", phrase)
        c = F.regexp_replace(c, f"(?iU)\\b{pattern}\\b", "")
    return strip(c)


def collapse_repeats(c: Column, threshold: int = REPEAT_THRESHOLD) -> Column:
    """A word said at least `threshold` times before a separator becomes one; a last repeat without a
    separator behind it stays. A threshold of 1 or less changes nothing."""
    if threshold <= 1:
        return c
    return F.regexp_replace(c, f"(?iU)\\b(\\w+)[,\\s]+(?:\\1\\b[,\\s]+){{{threshold - 1},}}", "$1 ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def valid_chunk(c: Column, min_words: int = MIN_WORDS) -> Column:
    return F.coalesce(F.size(words(c)) >= min_words, F.lit(False))


def split_pieces(c: Column, mark: str = JOIN_MARK) -> Column:
    return F.filter(F.split(c, mark), lambda x: strip(x) != "")


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of at least two word characters."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*stop_words)) if stop_words else found


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def query_prompt(c: Column, task: str = QUERY_TASK) -> Column:
    """Prefix of instruction-tuned encoders on the query side."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), c)


# ---------------------------------------------------------------- Python helpers

def chunk_text(text: str, size: int = CHUNK_SIZE, separators: tuple = CHUNK_SEPARATORS) -> list[str]:
    """Cut a text into pieces of at most `size` characters at the coarsest separator that works.

    Neighbouring parts are joined again while they fit; a part that is too long by itself is cut with the
    next separator. Separators stay at the front of the part they precede; pieces are stripped.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark = separators[at]
    if mark == "":
        parts = list(text)
    else:
        cut = text.split(mark)
        parts = [p for p in [cut[0], *[mark + p for p in cut[1:]]] if p]
    out: list[str] = []
    held, length = [], 0

    def flush():
        nonlocal held, length
        piece = "".join(held).strip()
        if piece:
            out.append(piece)
        held, length = [], 0

    for part in parts:
        if len(part) >= size and mark != "":
            flush()
            rest = separators[at + 1:]
            out.extend(chunk_text(part, size, rest) if rest else [part])
            continue
        if length + len(part) > size:
            flush()
        held.append(part)
        length += len(part)
    flush()
    return out


def text_chunks(size: int = CHUNK_SIZE):
    """Arrow-batched function: text to its unique chunks in first-seen order (NULL gives an empty list)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: list(dict.fromkeys(chunk_text(t, size))) if isinstance(t, str) else [])
    return run


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, one machine-word-parallel step a token of `a`."""
    if len(a) == 0 or len(b) == 0:
        return 0
    where: dict = {}
    for i, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.LongType())
def lcs_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([lcs_length(x, y) if x is not None and y is not None else None
                         for x, y in zip(a, b)], dtype="Int64")


def edit_distance(a: list, b: list) -> int:
    """Edit distance of two token lists, one column of the table held as two bit vectors."""
    if len(a) == 0 or len(b) == 0:
        return len(a) + len(b)
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for token in b:
        match = where.get(token, 0)
        vertical = match | down
        horizontal = (((match & up) + up) ^ up) | match
        more = down | (~(horizontal | up) & full)
        less = up & horizontal
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more = ((more << 1) | 1) & full
        less = (less << 1) & full
        up = less | (~(vertical | more) & full)
        down = more & vertical
    return score


@F.pandas_udf(T.LongType())
def edit_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([edit_distance(x, y) if x is not None and y is not None else None
                         for x, y in zip(a, b)], dtype="Int64")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance over reference words, on stripped lower-cased text; NULL unless both are strings
    and the reference has a word."""
    ref, hyp = words(F.lower(strip(reference))), words(F.lower(strip(hypothesis)))
    return F.try_divide(edit_udf(ref, hyp), F.size(ref))


def rouge_l(candidate: Column, reference: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    """F1 of the longest common subsequence of two token arrays; 0 without overlap. `stem` makes the column
    expression of a token's stem; without it tokens are compared as they are."""
    if stem is not None:
        candidate, reference = F.transform(candidate, stem), F.transform(reference, stem)
    common = lcs_udf(candidate, reference)
    total = F.size(candidate) + F.size(reference)
    return F.when(total > 0, 2.0 * common / total).otherwise(F.lit(0.0))


# Texts whose terms a worker holds at a time.
TEXTS = 256
# Tokens of both sides whose n-grams are counted at a time.
GRAM_TOKENS = 500_000


def bleu_precision(max_order: int = 4):
    """Arrow function of two token arrays, candidate and reference: geometric mean of the clipped precisions of n-grams up to
    `max_order`, null if any of them is 0 or the candidate has too few tokens."""

    def of_rows(candidate: pa.Array, reference: pa.Array) -> np.ndarray:
        n = len(candidate)
        sides = (candidate, reference)
        lengths = np.concatenate([pc.list_value_length(s).fill_null(0).to_numpy(zero_copy_only=False) for s in sides])
        tokens = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode(null_encoding="encode")
        code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = len(tokens.dictionary) + 1
        ends = np.repeat(np.cumsum(lengths), lengths)
        row = np.repeat(np.concatenate([np.arange(n)] * 2), lengths)
        first_reference = int(lengths[:n].sum())
        gram, row_of, starts = row, np.arange(n), np.arange(len(code))
        logs = np.zeros(n)
        for order in range(1, max_order + 1):
            # an n-gram is the number of the shorter one at its start, which stands for the row too, and its last token
            starts = starts[ends[starts] - starts >= order]
            found, number = np.unique(gram[starts] * width + code[starts + order - 1], return_inverse=True)
            row_of = row_of[found // width]
            gram = np.empty(len(code), np.int64)
            gram[starts] = number
            mine = starts < first_reference
            counts = [np.bincount(number[side], minlength=len(found)) for side in (mine, ~mine)]
            hits = np.bincount(row_of, np.minimum(*counts), minlength=n)
            total = np.bincount(row[starts[mine]], minlength=n)
            with np.errstate(divide="ignore", invalid="ignore"):
                logs += np.log(hits / total)
        return np.where(np.isfinite(logs), np.exp(logs / max_order), np.nan)

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for candidate, reference in batches:
            load = np.cumsum([pc.list_value_length(s).fill_null(0).to_numpy(zero_copy_only=False)
                              for s in (candidate, reference)], axis=1).sum(axis=0)
            out, lo = [], 0
            while lo < len(candidate):
                hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + GRAM_TOKENS, side="right")))
                out.append(of_rows(candidate[lo:hi], reference[lo:hi]))
                lo = hi
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64(), from_pandas=True)
    return run


def term_counter(stop_words: list[str] | None = None):
    """Function for `mapInArrow`: batches of (id, text) to (id, terms, counts, n_tokens): the distinct tokens
    of each text with their number, and how many tokens it has.

    Counting inside the row spares a shuffle of all (document, term) pairs, and TEXTS texts at a time keep a worker small;
    `\\w` and `\\b` are Unicode here
    as they are in `tokens`.
    """
    token = re.compile(r"\b\w\w+\b")
    skip = frozenset(stop_words or [])

    def run(batches):
        for batch in (large.slice(at, TEXTS) for large in batches for at in range(0, large.num_rows, TEXTS)):
            terms, counts, ends, totals = [], [], [0], []
            for text in batch.column("text").to_pylist():
                before = len(terms)
                if text is not None:
                    for term, n in Counter(token.findall(text.lower())).items():
                        if term not in skip:
                            terms.append(term)
                            counts.append(n)
                ends.append(len(terms))
                totals.append(sum(counts[before:]))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), pa.array(totals, pa.int64())],
                ["id", "terms", "counts", "n_tokens"])
    return run


def word_pieces(c: Column) -> Column:
    """Words and single punctuation marks, case kept."""
    return F.regexp_extract_all(c, F.lit("(?U)\\w+|[^\\w\\s]"), F.lit(0))


def ascii_words(c: Column) -> Column:
    """Runs of lower-case letters and digits of the ASCII range."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
