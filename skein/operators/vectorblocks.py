"""Blocks of vectors, and the exact nearest neighbours of one block in others: what Python workers do for retrieval.dense_topk()."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block: vectors of one length in the order of (grp, id), which begin the groups `grps` at `starts`; `codes` are places in `tags`, -1 for null.
SCHEMA = "ids binary, vecs binary, grps array<string>, starts binary, tags array<string>, codes binary, first string, last string"
_ARROW = pa.schema([("ids", pa.binary()), ("vecs", pa.binary()), ("grps", pa.list_(pa.string())), ("starts", pa.binary()), ("tags", pa.list_(pa.string())), ("codes", pa.binary()), ("first", pa.string()), ("last", pa.string())])
#: Rows and columns of one matrix product, which stay in a core's cache, and candidates by k above which a row is compared exactly at once.
ROWS, COLUMNS, MANY = 512, 512, 16


def _changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def pack(batches: Iterable[pa.RecordBatch], most: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks of up to `most` of the rows (id, vec, grp, tag), which come in order."""
    held: list[pa.Table] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        grp = rows["grp"].to_numpy(zero_copy_only=False)
        starts, tag = _changes(grp), rows["tag"].chunk(0).dictionary_encode()
        vecs = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["vec"].chunks]).astype(kind)
        codes = tag.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("i4")
        ids = rows["id"].to_numpy().astype("i8")
        made = [ids.tobytes(), vecs.tobytes(), list(grp[starts]), starts.astype("i4").tobytes(), tag.dictionary.to_pylist(), codes.tobytes(), grp[0], grp[-1]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, _ARROW, strict=True)], schema=_ARROW)

    def full(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held)
        held.clear()
        lengths = pc.list_value_length(rows["vec"]).to_numpy()
        cuts = [*_changes(lengths), len(lengths)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for k in range(a, b, most):
                if k + most < b or last or b < len(lengths):
                    yield block(rows.slice(k, min(most, b - k)))
                else:
                    held.append(rows.slice(k, b - k))

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) > most:
                yield from full(False)
    if held:
        yield from full(True)


class Block:
    """Parsed columns of a block; `unit` are its vectors with a length of one in 32 bits, which only choose candidates."""

    def __init__(self, kind: str, ids: bytes, vecs: bytes, grps: list[str], starts: bytes, tags: list[str], codes: bytes):
        self.ids = np.frombuffer(ids, "i8").copy()
        self.vecs = np.frombuffer(vecs, kind).reshape(len(self.ids), -1).copy()
        x = self.vecs.astype("f8")
        self.norms = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
        self.unit = (x / self.norms[:, None]).astype("f4")
        edges = [*np.frombuffer(starts, "i4").tolist(), len(self.ids)]
        self.runs = {g: (edges[k], edges[k + 1]) for k, g in enumerate(grps)}
        self.tags, self.codes = tags, np.frombuffer(codes, "i4").copy()

    def exact(self, which: slice | np.ndarray) -> np.ndarray:
        return self.vecs[which].astype("f8") / self.norms[which, None]


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero() for few true values: eight are looked at together."""
    flat, width = mask.ravel(), mask.shape[1]
    if width % 8:
        return np.nonzero(mask)
    words = np.flatnonzero(flat.view("u8"))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    at = at[flat[at]]
    return at // width, at % width


class Best:
    """The k best of what the sources of a block met, by falling score and rising id."""

    def __init__(self, own: Block, k: int, digits: int):
        self.own, self.k, self.digits = own, k, digits
        m = len(own.ids)
        self.scores, self.ids = np.full((m, k), -np.inf), np.zeros((m, k), "i8")
        self.last = np.full(m, np.iinfo("i8").min)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.unit64 = own.exact(slice(None))
        #: What rounding to digits and products of 32 bits can be off by at most.
        self.half = 0.5 * 10.0**-digits
        self.slack = (self.unit64.shape[1] + 8) * 2.0**-23 + self.half + 1e-9

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (ids != self.own.ids[rows]) & (scores >= self.least[rows]) & np.isfinite(scores)
        if keep.any():
            self.pending.append((rows[keep], scores[keep], ids[keep]))
            self.waiting += int(keep.sum())
        if self.waiting > max(1, len(self.own.ids) * self.k // 2):
            self.merge()

    def merge(self) -> None:
        if not self.pending:
            return
        rows, scores, ids = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending, self.waiting = [], 0
        met = np.unique(rows)
        rows = np.r_[rows, np.repeat(met, self.k)]
        scores, ids = np.r_[scores, self.scores[met].ravel()], np.r_[ids, self.ids[met].ravel()]
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        begins = _changes(rows)
        place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.r_[begins, len(rows)]))
        top = place < self.k
        self.scores[rows[top], place[top]], self.ids[rows[top], place[top]] = scores[top], ids[top]

    def meet(self, other: Block) -> None:
        """Compares the sources with all vectors of another block that are in their group."""
        known = {t: k for k, t in enumerate(self.own.tags)}
        codes = np.array([known.get(t, -2) for t in other.tags] + [-2], "i4")[other.codes] if known and other.tags else None
        for group, (a, b) in self.own.runs.items():
            if group in other.runs:
                c, d = other.runs[group]
                for i in range(a, b, ROWS):
                    for j in range(c, d, COLUMNS):
                        self._meet(slice(i, min(b, i + ROWS)), other, slice(j, min(d, j + COLUMNS)), codes)
                self.last[a:b] = np.maximum(self.last[a:b], other.ids[d - 1])

    def _meet(self, r: slice, other: Block, c: slice, codes: np.ndarray | None) -> None:
        allowed = None
        if codes is not None:
            allowed = self.own.codes[r, None] != codes[None, c]
            if not allowed.any():
                return
        if (self.least[r] == -np.inf).any():
            self.merge()
        unfilled = self.least[r] == -np.inf
        if unfilled.any():
            self._fill(np.flatnonzero(unfilled) + r.start, other, c, None if allowed is None else allowed[unfilled])
            if unfilled.all():
                return
        mask = self.own.unit[r] @ other.unit[c].T >= (self.least[r] - self.slack).astype("f4")[:, None]
        if allowed is not None:
            mask &= allowed
        mask[unfilled] = False
        if np.count_nonzero(mask) > MANY * self.k:
            many = np.flatnonzero(np.count_nonzero(mask, axis=1) > MANY * self.k)
            if many.size:
                self._strict(many + r.start, other, c, None if allowed is None else allowed[many])
                mask[many] = False
        rows, columns = _where(mask)
        rows, columns = rows + r.start, columns + c.start
        for k in range(0, len(rows), 1 << 15):
            i, j = rows[k : k + (1 << 15)], columns[k : k + (1 << 15)]
            self.add(i, np.round(np.einsum("ij,ij->i", self.unit64[i], other.exact(j)), self.digits), other.ids[j])

    def _strict(self, rows: np.ndarray, other: Block, c: slice, allowed: np.ndarray | None) -> None:
        """For rows that 32 bits can't tell from many others, as copies: exact scores; of ids above all before, an equal score is none of the best."""
        scores = self.unit64[rows] @ other.exact(c).T
        later = other.ids[c.start] > np.maximum(self.last[rows], other.ids[c.start - 1] if c.start else self.last[rows])
        mask = scores >= (self.least[rows] + np.where(later, self.half, -self.half) - 1e-9)[:, None]
        if allowed is not None:
            mask &= allowed
        i, j = np.nonzero(mask)
        self.add(rows[i], np.round(scores[i, j], self.digits), other.ids[j + c.start])

    def _fill(self, rows: np.ndarray, other: Block, c: slice, allowed: np.ndarray | None) -> None:
        """For rows that have no k others yet: the k best of all of them, of equal ones those with the smallest ids."""
        scores = np.round(self.unit64[rows] @ other.exact(c).T, self.digits)
        scores[~np.isfinite(scores) | (self.own.ids[rows, None] == other.ids[None, c])] = -np.inf
        if allowed is not None:
            scores[~allowed] = -np.inf
        if scores.shape[1] > self.k:
            least = np.partition(scores, -self.k, axis=1)[:, -self.k, None]
            above, equal = scores > least, scores == least
            mask = above | (equal & (np.cumsum(equal, axis=1) <= self.k - above.sum(axis=1, keepdims=True)))
        else:
            mask = np.ones(scores.shape, bool)
        i, j = np.nonzero(mask)
        self.add(rows[i], scores[i, j], other.ids[j + c.start])
        self.merge()


def search(batches: Iterable[pa.RecordBatch], k: int, kind: str, digits: int) -> Iterator[pa.RecordBatch]:
    """(source, neighbor, score): the k best for each source of left blocks among all right blocks with which they come."""
    columns = ("ids", "vecs", "grps", "starts", "tags", "codes")
    best: dict[int, Best] = {}
    parsed: dict[int, Block] = {}

    def parse(batch: pa.RecordBatch, row: int, side: str) -> Block:
        key = batch[f"{side}_block"][row].as_py()
        if key not in parsed:
            parsed[key] = Block(kind, *[batch[f"{side}_{c}"][row].as_py() for c in columns])
        return parsed[key]

    for batch in batches:
        for row in range(batch.num_rows):
            key = batch["l_block"][row].as_py()
            if key not in best:
                best[key] = Best(parse(batch, row, "l"), k, digits)
            best[key].meet(parse(batch, row, "r"))
    for one in best.values():
        one.merge()
        ok = np.isfinite(one.scores)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(one.own.ids, ok.sum(axis=1))), pa.array(one.ids[ok]), pa.array(one.scores[ok] + 0.0)], names=["source", "neighbor", "score"])
