"""Score matrices of two blocks of records, as numpy inside a Spark task.

A scorer names the columns it needs, turns an Arrow table into arrays once per cell (`prepare`) and
scores a slice of query rows against all corpus rows of the cell (`score`). Larger is always better:
distances come back negated. Scorers are small picklable objects; Spark decides which block meets which.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Products of sparse vectors that are computed at a time, few enough for a core's cache.
PRODUCTS = 65_536
# Terms of more than one in so many corpus rows are multiplied as whole rows, the most frequent ones at most.
COMMON_SHARE = 12
COMMON_TERMS = 1024
# Values of a distance matrix whose pairs are reduced at a time, so that they stay in a core's cache.
REDUCED = 200_000


def list_matrix(column) -> np.ndarray:
    """ARRAY<FLOAT|DOUBLE> column to a (rows, width) float64 matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(array), -1)


def nested_matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """ARRAY<ARRAY<..>> column to (all vectors stacked, number of vectors per row)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = pc.list_value_length(array).to_numpy(zero_copy_only=False).astype(np.int64)
    return list_matrix(array.flatten()), counts


def _lengths(x: np.ndarray, least: float = 0.0, more: float = 0.0, out: np.ndarray | None = None) -> np.ndarray:
    """Rows scaled by their length; `least` bounds the length from below, `more` is added to it."""
    return np.divide(x, (np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), least) + more)[:, None], out=out)


def _one_minus(x: np.ndarray) -> np.ndarray:
    return np.subtract(1.0, x, out=x)


def _square_distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    far = q @ c.T
    far *= 2.0
    np.subtract(np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", c, c), far, out=far)
    return np.maximum(far, 0.0, out=far)


def _power_distance(q: np.ndarray, c: np.ndarray, p: float) -> np.ndarray:
    if p == 2.0:
        return np.sqrt(_square_distance(q, c))
    return np.stack([(np.abs(c - row) ** p).sum(1) ** (1.0 / p) for row in q]) if len(q) else np.empty((0, len(c)))


#: mode -> matrix of values between rows of q and of c; `n` in front divides by the width, as its distance demands.
MODES = {
    "cosine": lambda q, c, p, eps: _lengths(q, 1e-12) @ _lengths(c, 1e-12).T,
    "angle": lambda q, c, p, eps: 1.0 - _lengths(q, 1e-12) @ _lengths(c, 1e-12).T,
    "cossim": lambda q, c, p, eps: _lengths(q, 0.0, eps) @ _lengths(c, 0.0, eps).T,
    "cos": lambda q, c, p, eps: 1.0 - _lengths(q, 0.0, eps) @ _lengths(c, 0.0, eps).T,
    "dotsim": lambda q, c, p, eps: q @ c.T,
    "dot": lambda q, c, p, eps: _one_minus(q @ c.T),
    "sqeuc": lambda q, c, p, eps: _square_distance(q, c),
    "nsqeuc": lambda q, c, p, eps: _square_distance(q, c) / q.shape[1],
    "euc": lambda q, c, p, eps: np.sqrt(_square_distance(q, c)),
    "neuc": lambda q, c, p, eps: np.sqrt(_square_distance(q, c) / q.shape[1]),
    "fro": lambda q, c, p, eps: _power_distance(q, c, p),
    "nfro": lambda q, c, p, eps: _power_distance(q, c, p) / q.shape[1] ** (1.0 / p),
}


def score_block(q: np.ndarray, c: np.ndarray, mode: str, p: float = 2.0, eps: float = 1e-6) -> np.ndarray:
    """Matrix of `mode` values (a distance, or a similarity for the `sim` modes) between rows of q and of c."""
    if mode not in MODES:
        raise ValueError(f"unknown distance mode: {mode}")
    return MODES[mode](q, c, p, eps)


SIMILARITY_MODES = ("cosine", "cossim", "dotsim")

#: Modes over scaled vectors: (`least` and `more` of the lengths, the mode that remains for vectors scaled beforehand).
SCALED = {"cosine": (1e-12, 0.0, "dotsim"), "angle": (1e-12, 0.0, "dot"), "cossim": (0.0, 1e-6, "dotsim"), "cos": (0.0, 1e-6, "dot")}


def scaled(x: np.ndarray, mode: str) -> np.ndarray:
    """Vectors of `list_matrix` as `scaled_block` takes them, so that a cell scales them once and not with every block. In place
    unless they lie in an Arrow buffer."""
    return _lengths(x, *SCALED[mode][:2], out=x if x.flags.writeable else None) if mode in SCALED else x


def scaled_block(q: np.ndarray, c: np.ndarray, mode: str, p: float = 2.0) -> np.ndarray:
    """`score_block` of vectors from `scaled`."""
    return score_block(q, c, SCALED[mode][2] if mode in SCALED else mode, p)


@dataclass
class DenseScorer:
    """One vector a record; `mode` is `cosine` (guarded norm) or one of the distance modes."""

    column: str = "embedding"
    mode: str = "cosine"
    p: float = 2.0

    @property
    def columns(self):
        return [self.column]

    def weight(self, table: pa.Table) -> np.ndarray:
        return np.ones(table.num_rows, dtype=np.int64)

    def prepare(self, table: pa.Table):
        return scaled(list_matrix(table[self.column]), self.mode)

    def score(self, q, c, lo: int, hi: int) -> np.ndarray:
        values = scaled_block(q[lo:hi], c, self.mode, self.p)
        return values if self.mode in SIMILARITY_MODES else np.negative(values, out=values)


def split_redux(redux: str) -> tuple[str, int | None]:
    """`best-3` -> (`best`, 3); `bpwr` -> (`bpwr`, None); a missing k of the others is 1."""
    name, _, k = redux.partition("-")
    if k:
        return name, max(1, int(k))
    return name, None if name.endswith("bpwr") else 1


PLAIN_REDUX = ("min", "max", "mean", "minmean", "meanmin", "meanmax")
LIST_REDUX = ("best", "worst", "bestmin", "bpwr")


def check_redux(redux: str) -> None:
    name = split_redux(redux)[0]
    if name in PLAIN_REDUX + LIST_REDUX or (name[:1] == "s" and name[1:] in PLAIN_REDUX + LIST_REDUX):
        return
    raise ValueError(f"unknown reduction: {redux}")


def best_pairs(d: np.ndarray, k: int | None) -> float:
    """Mean of the k smallest entries taken one after the other, each time dropping its row and column."""
    left = d.copy()
    picks = min(d.shape) if k is None else min(k, min(d.shape))
    total = 0.0
    for _ in range(picks):
        at = int(np.argmin(left))
        row, col = divmod(at, left.shape[1])
        total += left[row, col]
        left[row, :] = np.inf
        left[:, col] = np.inf
    return total / picks


def reduce_one(d: np.ndarray, redux: str) -> float:
    """Reduce the distance matrix of one pair of records (query vectors x corpus vectors)."""
    name, k = split_redux(redux)
    if name == "best":
        return float(np.sort(d, axis=None)[:k].mean())
    if name == "worst":
        return float(np.sort(d, axis=None)[::-1][:k].mean())
    if name == "bestmin":
        return float(np.sort(d.min(1))[:k].mean())
    if name == "bpwr":
        return best_pairs(d, k)
    if name in PLAIN_REDUX:
        return float(reduce_grid(d, np.array([d.shape[0]]), np.array([d.shape[1]]), redux)[0, 0])
    if name[:1] == "s":
        return 0.5 * (reduce_one(d, redux[1:]) + reduce_one(d.T, redux[1:]))
    raise ValueError(f"unknown reduction: {redux}")


def reduce_grid(d: np.ndarray, q_counts: np.ndarray, c_counts: np.ndarray, redux: str) -> np.ndarray:
    """Reduce the stacked distance matrix of many records to one value per (query, corpus) pair."""
    q_at = np.concatenate([[0], np.cumsum(q_counts)[:-1]])
    c_at = np.concatenate([[0], np.cumsum(c_counts)[:-1]])
    name, _ = split_redux(redux)
    if name == "min":
        return np.minimum.reduceat(np.minimum.reduceat(d, c_at, axis=1), q_at, axis=0)
    if name == "max":
        return np.maximum.reduceat(np.maximum.reduceat(d, c_at, axis=1), q_at, axis=0)
    if name == "mean":
        return np.add.reduceat(np.add.reduceat(d, c_at, axis=1), q_at, axis=0) / np.outer(q_counts, c_counts)
    if name == "meanmin":
        return np.add.reduceat(np.minimum.reduceat(d, c_at, axis=1), q_at, axis=0) / q_counts[:, None]
    if name == "meanmax":
        return np.add.reduceat(np.maximum.reduceat(d, c_at, axis=1), q_at, axis=0) / q_counts[:, None]
    if name == "minmean":
        return np.minimum.reduceat(np.add.reduceat(d, c_at, axis=1) / c_counts[None, :], q_at, axis=0)
    if name[:1] == "s" and name[1:] in PLAIN_REDUX:
        back = reduce_grid(np.ascontiguousarray(d.T), c_counts, q_counts, redux[1:]).T
        return 0.5 * (reduce_grid(d, q_counts, c_counts, redux[1:]) + back)
    out = np.empty((len(q_counts), len(c_counts)))
    for rows, cols, pairs in same_size(d, q_counts, c_counts):
        out[np.ix_(rows, cols)] = reduce_pairs(pairs, redux)
    return out


def same_size(d: np.ndarray, q_counts: np.ndarray, c_counts: np.ndarray):
    """(query records, corpus records, matrices) of the stacked matrix: records with equally many vectors at a time, as an
    array query record x corpus record x query vector x corpus vector of about REDUCED values."""
    q_at, c_at = (np.concatenate([[0], np.cumsum(n)[:-1]]) for n in (q_counts, c_counts))
    wide = [(b, np.flatnonzero(c_counts == b)) for b in np.unique(c_counts)]
    for a in np.unique(q_counts):
        tall = np.flatnonzero(q_counts == a)
        for b, cols in wide:
            step = max(1, REDUCED // int(a * b * len(cols)))
            places = (c_at[cols][:, None] + np.arange(b)).ravel()
            dense = len(places) == places[-1] - places[0] + 1
            for lo in range(0, len(tall), step):
                rows = tall[lo:lo + step]
                part = d[(q_at[rows][:, None] + np.arange(a)).ravel()]
                part = part[:, places[0]:places[-1] + 1] if dense else part[:, places]
                yield rows, cols, part.reshape(len(rows), a, len(cols), b).transpose(0, 2, 1, 3)


def reduce_pairs(pairs: np.ndarray, redux: str) -> np.ndarray:
    """`reduce_one` of every matrix in the last two axes."""
    name, k = split_redux(redux)
    lead, (a, b) = pairs.shape[:2], pairs.shape[2:]
    if name in ("best", "worst"):
        values = pairs.reshape(*lead, a * b)
        if name == "best":
            return least_mean(values, k)
        return np.where(np.isnan(values).any(axis=-1), np.nan, -least_mean(-values, k))
    if name == "bestmin":
        return least_mean(pairs.min(axis=3), k)
    if name == "bpwr":
        return least_picks(pairs.reshape(-1, a * b), a, b, k).reshape(lead)
    if name[:1] == "s":
        return 0.5 * (reduce_pairs(pairs, redux[1:]) + reduce_pairs(pairs.swapaxes(2, 3), redux[1:]))
    raise ValueError(f"unknown reduction: {redux}")


def least_mean(values: np.ndarray, k: int) -> np.ndarray:
    """Mean of the k smallest values of the last axis, all if it has fewer; a NaN counts as the largest."""
    n = values.shape[-1]
    if k > 4 or n > 64:
        return np.sort(np.partition(values, k - 1, axis=-1)[..., :k] if k < n else values, axis=-1).mean(axis=-1)
    # few: each value in turn sinks into the k smallest so far, for all pairs at once
    least = [np.full(values.shape[:-1], np.inf) for _ in range(min(k, n))]
    for x in np.ascontiguousarray(np.moveaxis(values, -1, 0)):
        for i, held in enumerate(least):
            least[i], x = np.minimum(held, x), np.maximum(held, x) if i + 1 < len(least) else None
    total = least[0]
    for x in least[1:]:
        total = total + x
    bad = np.isnan(total)
    if bad.any():
        total[bad] = np.sort(values[bad], axis=-1)[:, :len(least)].sum(axis=-1)
    return total / len(least)


def least_picks(left: np.ndarray, a: int, b: int, k: int | None) -> np.ndarray:
    """`best_pairs` of many flat a x b matrices: what a pick leaves is gathered into smaller matrices."""
    picks = min(a, b) if k is None else min(k, a, b)
    total = np.zeros(len(left))
    for i in range(picks):
        at = left.argmin(axis=1)
        total += np.take_along_axis(left, at[:, None], axis=1)[:, 0]
        if i + 1 == picks:
            break
        row, col = np.divmod(at, b)
        a, b = a - 1, b - 1
        # the rows and columns that stay, in their order
        up, across = np.arange(a), np.arange(b)
        up, across = up + (up >= row[:, None]), across + (across >= col[:, None])
        left = np.take_along_axis(left, (up[:, :, None] * (b + 1) + across[:, None, :]).reshape(len(left), -1), axis=1)
    return total / picks


@dataclass
class MultiVectorScorer:
    """Several vectors a record, reduced to one value a pair."""

    column: str = "vectors"
    mode: str = "cosine"
    redux: str = "meanmax"

    @property
    def columns(self):
        return [self.column]

    def weight(self, table: pa.Table) -> np.ndarray:
        return pc.list_value_length(table[self.column]).to_numpy().astype(np.int64)

    def prepare(self, table: pa.Table):
        vectors, counts = nested_matrix(table[self.column])
        return scaled(vectors, self.mode), counts, np.concatenate([[0], np.cumsum(counts)])

    def pair_values(self, q, c, lo: int, hi: int) -> np.ndarray:
        return scaled_block(q[0][q[2][lo]:q[2][hi]], c[0], self.mode)

    def score(self, q, c, lo: int, hi: int) -> np.ndarray:
        values = reduce_grid(self.pair_values(q, c, lo, hi), q[1][lo:hi], c[1], self.redux)
        return values if self.mode in SIMILARITY_MODES else -values


@dataclass
class FrameShiftScorer(MultiVectorScorer):
    """For two records of one label, the shift of their chunk indexes in place of a score; others get -inf.

    Every chunk of the query takes its nearest chunk at another index (ties to the smaller index); the shift is the most
    frequent index difference, ties to the one seen at the smallest index. Chunks are in index order.
    """

    mode: str = "euc"
    index: str = "idx"

    @property
    def columns(self):
        return [self.column, self.index]

    def prepare(self, table: pa.Table):
        index = table[self.index].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        by_label: dict = {}
        for row, label in enumerate(table["label"].to_pylist()):
            by_label.setdefault(label, []).append(row)
        return *super().prepare(table), index, table["label"].to_pylist(), by_label

    def score(self, q, c, lo: int, hi: int) -> np.ndarray:
        out = np.full((hi - lo, len(c[1])), -np.inf)
        rows_of: dict = {}
        for r in range(lo, hi):
            if q[4][r] is not None and q[4][r] in c[5]:
                rows_of.setdefault(q[4][r], []).append(r)
        for label, rows in rows_of.items():
            rows, cols = np.array(rows), np.array(c[5][label])
            own, other = ((np.concatenate([np.arange(x[2][i], x[2][i + 1]) for i in at])) for x, at in ((q, rows), (c, cols)))
            far = np.round(score_block(q[0][own], c[0][other], self.mode), 9)
            far[q[3][own][:, None] == c[3][other][None, :]] = np.inf
            starts_q, starts_c = (np.concatenate([[0], np.cumsum(n)]) for n in (q[1][rows], c[1][cols]))
            for some, others, pairs in same_size(far, q[1][rows], c[1][cols]):
                a, b = pairs.shape[2:]
                mine = q[3][own][starts_q[some][:, None] + np.arange(a)]
                theirs = c[3][other][starts_c[others][:, None] + np.arange(b)]
                nearest = pairs.argmin(axis=3)
                found = np.take_along_axis(pairs, nearest[..., None], axis=3)[..., 0] < np.inf
                shift = mine[:, None, :] - theirs[np.arange(len(others))[None, :, None], nearest]
                out[np.ix_(rows[some] - lo, cols[others])] = self._winner(shift, found)
        return out

    @staticmethod
    def _winner(shift: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The most frequent value of the last axis among the `found`, ties to the first; -inf without any."""
        n = shift.shape[2]
        votes = np.zeros(shift.shape, dtype=np.int32)
        for i in range(n):
            votes += (shift == shift[..., i:i + 1]) & found[..., i:i + 1]
        votes[~found] = 0
        at = votes.argmax(axis=2)[..., None]
        best = np.take_along_axis(shift, at, axis=2)[..., 0].astype(np.float64)
        return np.where(found.any(axis=2), best, -np.inf)


@dataclass
class SparseScorer:
    """Sum over shared terms of query weight times corpus weight; no shared term gives 0."""

    terms: str = "terms"
    weights: str = "weights"

    @property
    def columns(self):
        return [self.terms, self.weights]

    def weight(self, table: pa.Table) -> np.ndarray:
        return np.ones(table.num_rows, dtype=np.int64)

    def prepare(self, table: pa.Table):
        terms = table[self.terms].combine_chunks()
        counts = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        weights = table[self.weights].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # packed rows come with their terms numbered
        flat = coded(terms.flatten())
        return {"words": flat.dictionary, "code": flat.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                "weights": weights.astype(np.float64), "rows": np.repeat(np.arange(len(counts)), counts), "n": len(counts)}

    def _shared(self, q, c):
        """Codes of the query postings among the terms of the corpus side, whose postings are sorted by term; built once per cell."""
        if "with" in q and q["with"][0] is c:
            return q["with"][1]
        # words of the two sides are compared, not their postings
        known = pc.index_in(q["words"], value_set=c["words"]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known[q["code"]]
        wanted = np.zeros(len(c["words"]) + 1, dtype=bool)
        wanted[code] = True
        order = np.flatnonzero(wanted[:-1][c["code"]])
        # term and place as one number, as plain numbers are sorted faster than places by term
        bits = len(order).bit_length()
        order = order[np.sort((c["code"][order] << bits) + np.arange(len(order))) & ((1 << bits) - 1)]
        c_code, c_rows, c_w = (c[name][order] for name in ("code", "rows", "weights"))
        sizes = np.bincount(c_code, minlength=len(c["words"]))
        # frequent terms are multiplied as whole rows
        common = np.flatnonzero(sizes * COMMON_SHARE > c["n"])
        if len(common) > COMMON_TERMS:
            common = np.sort(common[np.argsort(-sizes[common], kind="stable")[:COMMON_TERMS]])
        place = np.full(len(sizes) + 1, -1)
        place[common] = np.arange(len(common))
        right = np.zeros((len(common), c["n"]))
        here = np.flatnonzero(place[c_code] >= 0)
        np.add.at(right.reshape(-1), place[c_code[here]] * c["n"] + c_rows[here], c_w[here])
        q["with"] = (c, (code, place[code], c_rows.astype(np.int32), c_w, np.concatenate([[0], np.cumsum(sizes)]), right))
        return q["with"][1]

    def score(self, q, c, lo: int, hi: int) -> np.ndarray:
        code, of_common, c_rows, c_w, starts, right = self._shared(q, c)
        first, last = np.searchsorted(q["rows"], [lo, hi])
        code, of_common, rows, w = code[first:last], of_common[first:last], q["rows"][first:last] - lo, q["weights"][first:last]
        picked = of_common >= 0
        left = np.zeros((hi - lo, len(right)))
        np.add.at(left.reshape(-1), rows[picked] * len(right) + of_common[picked], w[picked])
        out = left @ right
        rest = (code >= 0) & ~picked
        code, rows, w = code[rest], rows[rest], w[rest]
        begin = starts[code]
        sizes = starts[code + 1] - begin
        ends = np.cumsum(sizes)
        begin -= ends - sizes
        flat, at, done = out.reshape(-1), 0, 0
        while at < len(code):
            # as many query postings at a time as give PRODUCTS products, at least one
            upto = max(at + 1, int(np.searchsorted(ends, done + PRODUCTS, side="right")))
            n = sizes[at:upto]
            found = np.arange(done, ends[upto - 1])
            found += np.repeat(begin[at:upto], n)
            cells = np.repeat(rows[at:upto] * c["n"], n)
            cells += c_rows.take(found, mode="clip")
            products = np.repeat(w[at:upto], n)
            products *= c_w.take(found, mode="clip")
            np.add.at(flat, cells, products)
            at, done = upto, int(ends[upto - 1])
        return out


def coded(flat: pa.Array) -> pa.DictionaryArray:
    """An array with its distinct values numbered; null is a value."""
    return flat if pa.types.is_dictionary(flat.type) else flat.dictionary_encode(null_encoding="encode")


@dataclass
class WeightedScorer:
    """Weighted sum of other scorers, for hybrid scores."""

    parts: list
    weights: list

    @property
    def columns(self):
        return [name for part in self.parts for name in part.columns]

    def weight(self, table: pa.Table) -> np.ndarray:
        return np.max([part.weight(table) for part in self.parts], axis=0)

    def prepare(self, table: pa.Table):
        return [part.prepare(table) for part in self.parts]

    def score(self, q, c, lo: int, hi: int) -> np.ndarray:
        return sum(w * part.score(q[i], c[i], lo, hi)
                   for i, (part, w) in enumerate(zip(self.parts, self.weights)))


@dataclass
class MaxScorer(WeightedScorer):
    """Element-wise maximum of the raw scores of other scorers."""

    weights: list = None

    def score(self, q, c, lo: int, hi: int) -> np.ndarray:
        return np.maximum.reduce([part.score(q[i], c[i], lo, hi) for i, part in enumerate(self.parts)])


@dataclass
class SoftmaxMeanScorer(WeightedScorer):
    """Mean of the row-wise softmaxes of other scorers. The row maximum and the row sum run over the whole
    corpus, so each query row carries them in `soft_max` and `soft_sum` (one entry a part)."""

    weights: list = None
    q_columns = ("soft_max", "soft_sum")

    def prepare(self, table: pa.Table):
        states = [part.prepare(table) for part in self.parts]
        if "soft_max" in table.column_names:
            states.append((list_matrix(table["soft_max"]), list_matrix(table["soft_sum"])))
        return states

    def score(self, q, c, lo: int, hi: int) -> np.ndarray:
        top, total = q[len(self.parts)]
        soft = [np.exp(part.score(q[i], c[i], lo, hi) - top[lo:hi, i:i + 1]) / total[lo:hi, i:i + 1]
                for i, part in enumerate(self.parts)]
        return sum(soft) / len(soft)
