"""What runs in the workers of graph.over_slices: slices of edges are read from the shared folder and met with each other; and
of graph.shared_sessions: pairs are packed for the shuffle, and weighed where they are dealt to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

#: Bytes of marks, candidates looked up at once, and rows of a batch that goes out.
MARKS, CANDIDATES, ROWS = 1 << 25, 1 << 20, 1 << 16
#: Pairs that are packed together.
PACKED = 1 << 20


def _read(folder: str, columns: list[str]) -> list[np.ndarray]:
    """The columns of all files of a folder; there is none where nothing was written."""
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    files = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    tables = [pq.read_table(f.path, columns=columns, filesystem=fs, partitioning=None) for f in sorted(files, key=lambda f: f.path) if f.base_name.startswith("part-")]
    if not tables:
        return [np.zeros(0, bool if c == "turned" else float if c == "weight" else np.int64) for c in columns]
    found = pa.concat_tables(tables)
    return [found[c].to_numpy() for c in columns]


class _Places:
    """Places of ids among sorted ids: by a table where ids are close, else by search."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.low = ids, int(ids[0]) if len(ids) else 0
        span = int(ids[-1]) - self.low + 1 if len(ids) else 0
        self.table = None
        if span <= 64 * len(ids) and span <= 1 << 25:
            self.table = np.zeros(span, np.int32)
            self.table[ids - self.low] = np.arange(len(ids), dtype=np.int32)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids - self.low].astype(np.int64) if self.table is not None else np.searchsorted(self.ids, ids)


def degrees(path: str, groups: int) -> Callable:
    """For each group: (id, degree) of its vertices, slice by slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            found = []
            for other in range(groups):
                u, v = _read(f"{path}/slice={min(k, other) * groups + max(k, other)}", ["u", "v"])
                for side in [u, v] if other == k else [u] if k < other else [v]:
                    found.append(np.unique(side, return_counts=True))
            ids, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([f[1] for f in found]), len(ids)).astype(np.int64)
            for a in range(0, len(ids), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + ROWS]), pa.array(n[a : a + ROWS])], ["id", "degree"])

    return run


def _meet(acc: np.ndarray, which: np.ndarray, row: np.ndarray, other: np.ndarray, marked: tuple, listed: tuple, worth: np.ndarray, nz: int) -> None:
    """Adds to acc[which] the worth of the neighbours that row has among marked and other among listed; which is in the order of
    row. Rows of marked are marked a few at a time, and the lists of others looked up there."""
    (keys, start), (others, first) = marked, listed
    width = max(1, MARKS // max(nz, 1))
    mark = np.zeros(width * nz, bool)
    size = first[other + 1] - first[other]
    upto = np.cumsum(size)
    at = 0
    while at < len(which):
        base = int(row[at])
        end = min(int(np.searchsorted(row, base + width)), max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, "right"))))
        on = keys[start[base] : start[int(row[end - 1]) + 1]] - base * nz
        mark[on] = True
        n = size[at:end]
        total = np.cumsum(n)
        z = others[np.repeat(first[other[at:end]] - total + n, n) + np.arange(total[-1])]
        hit = np.flatnonzero(mark[np.repeat((row[at:end] - base) * nz, n) + z])
        if len(hit):
            acc[which[at:end]] += np.bincount(np.searchsorted(total, hit, "right"), worth[z[hit]], end - at)
        mark[on] = False
        at = end


def over(path: str, ends: str, groups: int, pairs: list[tuple[int, int]], extra: list[str], common: bool) -> Callable:
    def end(k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        ids, *values = _read(f"{ends}/grp={k}", ["id", *extra, *(["degree"] if common else [])])
        order = np.argsort(ids)
        return ids[order], [v[order] for v in values]

    def arcs(x: int, y: int, px: _Places, py: _Places, nz: int) -> tuple:
        """The arcs from group x to y as sorted keys of both places, and where each row begins."""
        u, v = _read(f"{path}/slice={min(x, y) * groups + max(x, y)}", ["u", "v"])
        if x == y:
            u, v = np.concatenate([u, v]), np.concatenate([v, u])
        elif x > y:
            u, v = v, u
        keys = px(u) * nz
        keys += py(v)
        keys.sort()
        return keys, np.searchsorted(keys, np.arange(len(px.ids) + 1) * nz)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j in (pairs[p] for batch in batches for p in batch.column(0).to_pylist()):
            u, v, turned, weight = _read(f"{path}/slice={i * groups + j}", ["u", "v", "turned", "weight"])
            if not len(u):
                continue
            (ids_i, of_i), (ids_j, of_j) = end(i), end(j)
            pi, pj = _Places(ids_i), _Places(ids_j)
            ui, vj = pi(u), pj(v)
            out = [weight]
            if common:
                acc = np.zeros(len(u))
                by_u, by_v = np.argsort(ui, kind="stable"), np.argsort(vj, kind="stable")
                for k in range(groups):
                    ids, of = end(k)
                    pk, nz = _Places(ids), len(ids)
                    if not nz:
                        continue
                    worth = np.where(of[-1] > 1, 1 / np.log(np.maximum(of[-1], 2)), 0.0)
                    one = arcs(i, k, pi, pk, nz)
                    two = one if i == j else arcs(j, k, pj, pk, nz)
                    lists = [keys - np.repeat(np.arange(len(start) - 1) * nz, np.diff(start)) for keys, start in ((one, two) if i != j else (one,))]
                    one_z, two_z = lists[0], lists[-1]
                    nu, nv = np.diff(one[1])[ui], np.diff(two[1])[vj]
                    left, right = by_u[((nv <= nu) & (nv > 0))[by_u]], by_v[((nu < nv) & (nu > 0))[by_v]]
                    _meet(acc, left, ui[left], vj[left], one, (two_z, two[1]), worth, nz)
                    _meet(acc, right, vj[right], ui[right], two, (one_z, one[1]), worth, nz)
                out.append(acc)
            for e, (x, y) in enumerate(zip(of_i, of_j, strict=True)):
                if e < len(extra):
                    xu, yv = x[ui], y[vj]
                    out += [np.where(turned, yv, xu), np.where(turned, xu, yv)]
            out = [np.where(turned, v, u), np.where(turned, u, v), *out]
            names = ["a", "b", "weight", *(["adamic_adar"] if common else []), *[f"{c}_{e}" for c in extra for e in "ab"]]
            for a in range(0, len(u), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + ROWS]) for x in out], names)

    return run


def _packed(x: np.ndarray) -> bytes:
    """Integers by the places of their bytes, of which the upper are nearly all alike."""
    return pa.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def _pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
    """rows: session, entity, group and part, in the order of the first two. The pairs of each session, a few at a time: both
    entities, the slice and the part of the first."""
    at, k = np.arange(rows.shape[1]), 1
    while len(at := at[at + k < rows.shape[1]]) and len(at := at[rows[0, at] == rows[0, at + k]]):
        for i in range(0, len(at), PACKED):
            x, y = rows[1:, at[i : i + PACKED]], rows[1:, at[i : i + PACKED] + k]
            yield np.stack([x[0], y[0], np.minimum(x[1], y[1]), np.maximum(x[1], y[1]), x[2]])
        k += 1


def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (session, entity, grp, part), sorted by session and entity, as the pairs of entities that meet in a session, packed
    for each slice and part."""

    def sessions() -> Iterator[np.ndarray]:
        held, rows = [], 0
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not x.shape[1]:
                continue
            held.append(x)
            rows += x.shape[1]
            if rows >= ROWS and held[0][0, 0] != x[0, -1]:
                x = np.concatenate(held, axis=1)
                end = int(np.searchsorted(x[0], x[0, -1]))  # the last session may go on
                yield x[:, :end]
                held, rows = [x[:, end:]], x.shape[1] - end
        if held:
            yield np.concatenate(held, axis=1)

    def bundles() -> Iterator[np.ndarray]:
        held, rows = [], 0
        for x in sessions():
            again = (x[0, 1:] == x[0, :-1]) & (x[1, 1:] == x[1, :-1])
            for pairs in _pairs(x[:, np.concatenate([[True], ~again])]):
                held.append(pairs)
                rows += pairs.shape[1]
                if rows >= PACKED:
                    yield np.concatenate(held, axis=1)
                    held, rows = [], 0
        if held:
            yield np.concatenate(held, axis=1)

    for x in bundles():
        x = x[:, np.lexsort((x[1], x[0], x[4], x[3], x[2]))]
        start = np.flatnonzero(np.concatenate([[True], (x[2:, 1:] != x[2:, :-1]).any(axis=0)]))
        end = np.append(start[1:], x.shape[1])
        data = [[_packed(np.diff(x[0, i:j], prepend=0)) for i, j in zip(start, end, strict=True)], [_packed(x[1, i:j]) for i, j in zip(start, end, strict=True)]]
        yield pa.RecordBatch.from_arrays([*[pa.array(x[c, start].astype(np.int32)) for c in (2, 3, 4)], pa.array(end - start), *[pa.array(d, pa.binary()) for d in data]], ["low", "high", "part", "n", "a", "b"])


def weighed(ends: str) -> Callable:
    """Packed pairs of one slice and part as (a, b, weight, n_a, n_b): each once, with its number, and the numbers of both ends."""

    def run(table: pa.Table) -> pa.Table:
        packs = table.select(["n", "a", "b"]).to_pylist()
        a = np.concatenate([np.cumsum(_unpacked(p["a"], p["n"])) for p in packs])
        b = np.concatenate([_unpacked(p["b"], p["n"]) for p in packs])
        found = [_read(f"{ends}/grp={k}", ["id", "n"]) for k in {table["low"][0].as_py(), table["high"][0].as_py()}]
        ids, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        keys, weight = np.unique(np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b), return_counts=True)
        x, y = np.divmod(keys, len(ids))
        return pa.table({"a": ids[x], "b": ids[y], "weight": weight.astype(float), "n_a": n[x], "n_b": n[y]})

    return run
