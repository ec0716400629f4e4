"""The most similar vectors of every vector: inverted lists and an adaptive scan of dimensions.

Vectors of one model and revision are brought to length 1 and rotated at random, so that partial
distances over the first columns estimate the whole. K-means centres, fitted on a bounded sample,
make the lists; every vector is in one list. Lists with near centres make a cell. The vectors of a cell are
written once, list by list, to a file of the shared folder; a cell of many rows to several files, its units.
A task searches for the vectors of one unit and reads from the files the lists it needs, one at a time, so
no vector is copied for the lists that it probes.

First each vector searches its own list, which gives it a threshold. Then it probes every other list
that can hold something nearer by the triangle inequality, nearest centres first: PROBES of them, and
more as the lists get more (``probes_for``), or all of them where an exact search is asked for. Each
list searched may lower the threshold. Within a list, its own included, the columns are read in
blocks; after each block a hypothesis test abandons the pairs whose partial distance is already too
large for the threshold. Survivors are measured exactly and ranked by the rounded cosine.

Equal vectors of many texts are searched once. Long lists are read in blocks, so no task holds an
unbounded list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.plans.lineage import cut, release, remove, shared_folder, spent_shuffles

NEIGHBOURS = 5
#: Centres are fitted on at most so many vectors of a model and revision ...
SAMPLE = 20_000
#: ... one for about so many vectors, and at most so many.
LIST_SIZE, MAX_LISTS = 400, 4096
ITERATIONS = 8
#: A vector probes so many other lists where there are PROBE_LISTS lists or fewer, and more with the square root of their number.
PROBES, PROBE_LISTS = 12, 256
BLOCK_ROWS = 4096
#: Lists are put together to cells of about so many vectors; a task searches for about so many.
UNIT_ROWS = 8192
MAX_TASKS = 20_000
COLUMN_BLOCK = 16
#: Significance of the test: a pair is abandoned if its partial distance exceeds the threshold by the factor (1 + EPSILON / sqrt(columns read)).
EPSILON = 2.1
SEED = 7


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(grp, text_id, ukey, vec): each text of a model and revision (and dimension: a grp) once; ukey is equal for equal directions.

    Left out are null text_ids, null vectors or dimensions, vectors of another length than their
    dimension, with an entry that is null or not finite, or with zeros only. Of several vectors of
    one text the smallest counts. Null models and revisions form groups of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, wanted = batch.column("vector"), batch.column("dimension").to_numpy(zero_copy_only=False)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            at, keys, kept = [], [], []
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero((sizes == d) & (wanted == d))
                if not len(rows):
                    continue
                flat = vectors.take(pa.array(rows)).flatten()
                x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), int(d))  # null entries become NaN
                wide = x.astype(np.float64)
                norm = np.sqrt((wide * wide).sum(axis=1))
                good = np.isfinite(wide).all(axis=1) & (norm > 0) & np.isfinite(norm)
                unit = wide[good] / norm[good][:, None] + 0.0
                at += rows[good].tolist()
                keys += [blake2b(u.tobytes(), digest_size=16).digest() for u in unit]
                kept += list(x[good])
            take = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("grp", "text_id")] + [pa.array(keys, type=pa.binary()), pa.array(kept, type=pa.list_(pa.float32()))], names=["grp", "text_id", "ukey", "vec"])

    rows = embeddings.where(F.col("text_id").isNotNull() & (F.size("vector") == F.col("dimension")) & (F.col("dimension") > 0))
    rows = rows.select(_group().alias("grp"), "text_id", F.col("dimension").cast("double").alias("dimension"), F.col("vector").cast("array<float>").alias("vector"))
    found = rows.mapInArrow(run, "grp string, text_id string, ukey binary, vec array<float>")
    return found.groupBy("grp", "text_id").agg(F.min(F.struct("ukey", "vec")).alias("v")).select("grp", "text_id", "v.ukey", "v.vec")


def _group() -> Column:
    return F.concat_ws("\u0001", F.coalesce(F.concat(F.lit("m"), "model"), F.lit("-")), F.coalesce(F.concat(F.lit("r"), "revision"), F.lit("-")), F.col("dimension").cast("string"))


def vector_classes(vectors: DataFrame, keep: int = NEIGHBOURS + 1) -> tuple[DataFrame, DataFrame]:
    """Vectors of one direction as one: (grp, rep, vec, members, more), and (grp, rep, text_id) of the classes with more members.

    members: the ``keep`` smallest text_ids, as no other can be a neighbour; more: whether there are others.
    The limit of the window holds before its shuffle too, so that a large class is no single task.
    """
    near = Window.partitionBy("grp", "ukey").orderBy("text_id")
    few = vectors.withColumn("n", F.row_number().over(near)).where(F.col("n") <= keep + 1)
    first = F.sort_array(F.collect_list("text_id"))
    top = few.groupBy("grp", "ukey").agg(F.slice(first, 1, keep).alias("members"), F.min_by("vec", "text_id").alias("vec"), (F.count("*") > keep).alias("more"))
    classes = cut(top.select("grp", "ukey", F.element_at("members", 1).alias("rep"), "vec", "members", "more"))
    owner = cut(vectors.select("grp", "ukey", "text_id").join(classes.where("more").select("grp", "ukey", "rep"), ["grp", "ukey"]).select("grp", "rep", "text_id"), vectors)
    return classes, owner


class Index:
    """Rotations, centres, radii and cells by group, and where the vectors of each list are."""

    def __init__(self, centres: dict[str, np.ndarray], rotations: dict[int, np.ndarray]) -> None:
        self.centres, self.rotations = centres, rotations
        self.cells: dict[str, np.ndarray] = {}
        self.radius: dict[str, np.ndarray] = {}
        self.probes: dict[str, int] = {}
        self.epsilon, self.keep = EPSILON, NEIGHBOURS + 1
        #: (file, number of its batch) of each block of a list of a group; a list has as many blocks as its cell has units, or more.
        self.parts: dict[tuple[str, int], list[tuple[str, int]]] = {}


def _cells(centres: np.ndarray, rows: int) -> np.ndarray:
    """The cell of each list: near centres together, so that cells hold about UNIT_ROWS of ``rows`` vectors."""
    k = min(len(centres), math.ceil(rows / UNIT_ROWS))
    return nearest(centres, k_means(centres, k))[0] if k > 1 else np.zeros(len(centres), dtype=np.int64)


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of the sample x, started on distinct rows; empty centres keep their place."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ITERATIONS):
        near = nearest(x, centres)[0]
        order = np.argsort(near, kind="stable")
        ids, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        counts = np.diff(np.append(first, len(x)))
        centres[ids] = sums / counts[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and its distance."""
    half = (centres * centres).sum(axis=1) / 2
    at = np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), 8192):
        at[a : a + 8192] = (x[a : a + 8192] @ centres.T - half).argmax(axis=1)
    gap = x - centres[at]
    return at, np.sqrt((gap * gap).sum(axis=1))


def fit_index(classes: DataFrame, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS) -> Index:
    """Fit the centres of every group on a bounded sample (smallest hashes); only the samples come to the driver."""
    sizes = {r.grp: r.n for r in classes.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    centres, rotations = {}, {}
    for grp, n in sorted(sizes.items()):
        share = min(1.0, 1.5 * SAMPLE / n)
        part = classes.where((F.col("grp") == grp) & (F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * share)))
        x = _units(part.select("vec").limit(2 * SAMPLE).toArrow().column("vec").combine_chunks())
        turn = rotations.setdefault(x.shape[1], rotation(x.shape[1]))
        k = max(1, min(max_lists, math.ceil(n / list_size), len(x)))
        centres[grp] = k_means((np.unique(x, axis=0) @ turn).astype(np.float32), k)
    index = Index(centres, rotations)
    index.cells = {g: _cells(c, sizes[g]) for g, c in centres.items()}
    return index


def _units(column) -> np.ndarray:
    """Rows of a list column of equal lengths, at length 1 in double precision."""
    x = _matrix(column).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None] if len(x) else x


def _matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def assign(classes: DataFrame, index: Index) -> DataFrame:
    """(grp, cell, list, rep, vec, members, more, gap): the cell and list of every vector and the distance to its centre."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), dtype=object)
            cells, lists, gaps = np.zeros(len(groups), dtype=np.int32), np.zeros(len(groups), dtype=np.int32), np.zeros(len(groups))
            for grp in set(groups.tolist()):
                rows = np.flatnonzero(groups == grp)
                x = _units(batch.column("vec").take(pa.array(rows)))
                at, gap = nearest((x @ index.rotations[x.shape[1]]).astype(np.float32), index.centres[grp])
                cells[rows], lists[rows], gaps[rows] = index.cells[grp][at], at, gap
            same = [batch.column(c) for c in ("grp", "rep", "vec", "members", "more")]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(cells), pa.array(lists), *same[1:], pa.array(gaps)], names=["grp", "cell", "list", "rep", "vec", "members", "more", "gap"])

    return classes.select("grp", "rep", "vec", "members", "more").mapInArrow(run, "grp string, cell int, list int, rep string, vec array<float>, members array<string>, more boolean, gap double")


def _stored(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def store(classes: DataFrame, index: Index, folder: str) -> None:
    """Write the vectors of each unit, list by list and sorted by rep, to a file of ``folder``; sets the parts and radii of ``index``.

    A block of a list is a record batch (rep, vec, turned, members, more); turned is the vector at length 1, rotated. A task
    that is run again replaces its file by an equal one.
    """
    spark = classes.sparkSession
    sizes = {(r.grp, r.cell): r.n for r in classes.groupBy("grp", "cell").agg(F.count("*").alias("n")).collect()}  # at most max_lists a group
    rotations, numbers = spark.sparkContext.broadcast(index.rotations), {g: i for i, g in enumerate(sorted(index.centres))}
    kinds = spark.createDataFrame([(g, c, numbers[g], math.ceil(n / UNIT_ROWS)) for (g, c), n in sizes.items()], "grp string, cell int, number int, units int")
    units = classes.join(F.broadcast(kinds), ["grp", "cell"]).withColumn("unit", F.pmod(F.xxhash64("rep"), F.col("units")).cast("int")).drop("units")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("list", "ascending"), ("rep", "ascending")]).combine_chunks()
        first = rows.slice(0, 1).to_pylist()[0]
        name = f"{first['number']}-{first['cell']}-{first['unit']}.arrow"
        files, folder_ = _stored(folder)
        files.create_dir(folder_)
        made = f"{folder_}/.{uuid4().hex}"
        lists, at, found = rows.column("list").to_numpy(), 0, []
        with files.open_output_stream(made) as out:
            writer = None
            while at < len(rows):
                end = min(at + BLOCK_ROWS, int(np.searchsorted(lists, lists[at], side="right")))
                part = rows.slice(at, end - at)
                x = _units(part.column("vec"))
                turned = (x @ rotations.value[x.shape[1]]).astype(np.float32)
                flat = lambda m, d: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m, dtype=np.float32).reshape(-1)), d)
                batch = pa.RecordBatch.from_arrays([part.column("rep").combine_chunks(), flat(_matrix(part.column("vec")), x.shape[1]), flat(turned, x.shape[1]), part.column("members").combine_chunks(), part.column("more").combine_chunks()], names=["rep", "vec", "turned", "members", "more"])
                writer = writer or pa.ipc.new_file(out, batch.schema)
                writer.write_batch(batch)
                found.append((first["grp"], int(lists[at]), name, len(found), float(pc.max(part.column("gap")).as_py())))
                at = end
            writer.close()
        files.move(made, f"{folder_}/{name}")
        return pa.table([pa.array(c) for c in zip(*found)], schema=pa.schema([("grp", pa.string()), ("list", pa.int32()), ("file", pa.string()), ("batch", pa.int32()), ("radius", pa.float64())]))

    made = units.groupBy("grp", "cell", "unit").applyInArrow(run, "grp string, list int, file string, batch int, radius double")
    index.radius = {g: np.full(len(c), -9.0, dtype=np.float32) for g, c in index.centres.items()}
    for r in sorted(made.collect()):  # a row for each block of a list
        index.parts.setdefault((r.grp, r.list), []).append((r.file, r.batch))
        index.radius[r.grp][r.list] = max(index.radius[r.grp][r.list], r.radius)


def adaptive_scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rotated rows of q and x whose squared distance is at most limit[i], as far as the test keeps them.

    Columns are read in blocks; the first block is one product, later ones only for pairs alive.
    """
    d = q.shape[1]
    step = min(COLUMN_BLOCK, d)
    a, b = q[:, :step], x[:, :step]
    allowed = lambda most, read: np.minimum(most, most * (read / d) * (1 + epsilon / math.sqrt(read)) ** 2) if read < d and epsilon < math.inf else most
    bound = allowed(limit, step)
    one = lambda m: np.ones((len(m), 1), dtype=m.dtype)
    over = np.hstack([-2 * a, ((a * a).sum(axis=1) - bound)[:, None].astype(a.dtype), one(a)]) @ np.hstack([b, one(b), (b * b).sum(axis=1)[:, None]]).T  # what the distance exceeds the bound by
    at = np.flatnonzero(over <= 1e-6)
    i, j = np.divmod(at, len(x))
    dist = over.ravel()[at] + bound[i]
    at = step
    while at < d and len(i):
        end = min(d, at + step)
        gap = q[i, at:end] - x[j, at:end]
        dist = dist + (gap * gap).sum(axis=1)
        at = end
        bound = allowed(limit[i], at)
        keep = dist <= bound + 1e-6
        i, j, dist = i[keep], j[keep], dist[keep]
    return i, j


def _kth(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """A squared distance to each row of q within which k rows of x lie, or 4 (opposite vectors).

    Rows that are near in the first column block are measured whole; the k-th nearest of them bounds
    the k-th nearest of all.
    """
    if len(x) < k:
        return np.full(len(q), 4.0, dtype=np.float32)
    a, b = q[:, :COLUMN_BLOCK], x[:, :COLUMN_BLOCK]
    part = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    few = min(len(x), 8 * k)
    near = np.argpartition(part, few - 1, axis=1)[:, :few] if few < len(x) else np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
    gap = x[near] - q[:, None, :]
    dist = np.einsum("ijk,ijk->ij", gap, gap)
    return np.partition(dist, k - 1, axis=1)[:, k - 1]


def probes_for(lists: int) -> int:
    """How many other lists a vector probes at most."""
    return math.ceil(PROBES * math.sqrt(max(1.0, lists / PROBE_LISTS)))


class _Found:
    """What was found for the vectors of a unit: the nearest classes so far and the thresholds that follow."""

    def __init__(self, rows: int, keep: int) -> None:
        self.keep = keep
        self.near = np.full((rows, keep), np.inf, dtype=np.float32)
        self.rows: list[np.ndarray] = []
        self.sims: list[np.ndarray] = []
        self.members: list[pa.Array] = []

    def add(self, i: np.ndarray, sim: np.ndarray, members: pa.Array) -> None:
        """Rows i, each with its pairs together, the nearest first."""
        self.rows.append(i)
        self.sims.append(sim)
        self.members.append(members)
        rows, first = np.unique(i, return_index=True)
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        some = place < self.keep
        new = np.full((len(rows), self.keep), np.inf, dtype=np.float32)
        new[np.searchsorted(rows, i[some]), place[some]] = 2 - 2 * sim[some]
        self.near[rows] = np.partition(np.hstack([self.near[rows], new]), self.keep - 1, axis=1)[:, : self.keep]

    def limits(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances within which as many classes as are wanted were found, or 4 (opposite vectors)."""
        return np.minimum(self.near[rows].max(axis=1), np.float32(4.0))


class _Unit:
    """The search for the vectors of one unit."""

    def __init__(self, grp: str, name: str, index: Index, folder: str) -> None:
        self.grp, self.index = grp, index
        self.files, self.folder = _stored(folder)
        lists = sorted((batch, at) for (g, at), parts in index.parts.items() if g == grp for file, batch in parts if file == name)
        with self.files.open_input_file(f"{self.folder}/{name}") as source:
            reader = pa.ipc.open_file(source)
            batches = [reader.get_batch(b) for b, _ in lists]
        self.own = np.repeat([at for _, at in lists], [len(b) for b in batches])
        self.rows = pa.Table.from_batches(batches).combine_chunks()
        self.u, self.q = _units(self.rows.column("vec")), _matrix(self.rows.column("turned"))
        self.found = _Found(len(self.q), index.keep)

    def _scan(self, asking: np.ndarray, at: int, own: bool) -> None:
        """Search list ``at`` for the rows asking. own: find the first thresholds here."""
        index, keep = self.index, self.index.keep
        for name, number in index.parts.get((self.grp, at), []):
            with self.files.open_input_file(f"{self.folder}/{name}") as source:
                batch = pa.ipc.open_file(source).get_batch(number)
            x, raw, members = _matrix(batch.column("turned")), _matrix(batch.column("vec")), batch.column("members")
            for a in range(0, len(asking), 256):
                rows = asking[a : a + 256]
                limit = self.found.limits(rows)
                if own:
                    limit = np.minimum(limit, _kth(self.q[rows], x, keep))
                i, j = adaptive_scan(self.q[rows], x, limit + np.float32(1e-5), index.epsilon)  # rounded cosines may tie
                if not len(i):
                    continue
                some, back = np.unique(j, return_inverse=True)
                wide = raw[some].astype(np.float64)
                wide /= np.sqrt((wide * wide).sum(axis=1))[:, None]
                sim = np.round(np.einsum("ij,ij->i", self.u[rows[i]], wide[back]), 6)
                order = np.lexsort((j, -sim, i))  # a block is sorted by rep
                i, j, sim = i[order], j[order], sim[order]
                first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < 2 * keep  # no more can be among the first texts, as each class has at least one
                self.found.add(rows[i[first]], sim[first], members.take(pa.array(j[first])))

    def search(self) -> None:
        index, grp = self.index, self.grp
        for at in np.unique(self.own).tolist():
            self._scan(np.flatnonzero(self.own == at), at, True)
        centres, most = index.centres[grp], index.probes[grp]
        rows_of, lists_of = [], []
        for a in range(0, len(self.q), 2048):
            y = self.q[a : a + 2048]
            rows = np.arange(a, a + len(y))
            dist = np.sqrt(np.maximum(0, (y * y).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (y @ centres.T)))
            dist[np.arange(len(y)), self.own[rows]] = np.inf
            open_ = dist - index.radius[grp][None, :] <= np.sqrt(self.found.limits(rows))[:, None] + 1e-5
            if len(centres) > most:
                open_ &= dist <= np.partition(dist, most - 1, axis=1)[:, most - 1][:, None]
            i, j = np.nonzero(open_)
            rows_of.append(rows[i])
            lists_of.append(j)
        asked, lists = np.concatenate(rows_of), np.concatenate(lists_of)
        order = np.argsort(lists, kind="stable")
        asked, lists = asked[order], lists[order]
        ids, first = np.unique(lists, return_index=True)
        bounds = np.append(first, len(lists))
        for n in np.argsort(-np.diff(bounds), kind="stable").tolist():  # those that most ask for are the nearest
            self._scan(asked[bounds[n] : bounds[n + 1]], int(ids[n]), False)

    def texts(self, k: int) -> pa.Table:
        """Rows of FOUND: the first k texts of each text, and the first k + 1 of each class that has members unknown here."""
        found, keep = self.found, self.index.keep
        i, sim = np.concatenate(found.rows), np.concatenate(found.sims)
        members = pa.concat_arrays(found.members)
        order = np.lexsort((-sim, i))
        ranked, first = sim[order], np.searchsorted(i[order], np.arange(len(self.q)))
        count = np.diff(np.append(first, len(i)))
        least = ranked[first + np.minimum(count, keep) - 1]  # each class has at least one text
        kept = np.flatnonzero(sim >= least[i])
        members = members.take(pa.array(kept))
        each = members.value_lengths().to_numpy()
        near = pa.table({"i": np.repeat(i[kept], each), "sim": np.repeat(sim[kept], each), "text": members.flatten()}).sort_by([("i", "ascending"), ("sim", "descending"), ("text", "ascending")])
        i, sim, text = near.column("i").to_numpy(), near.column("sim").to_numpy(), near.column("text").combine_chunks()
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        some = np.flatnonzero(place <= k)
        i, sim, place, text = i[some], sim[some], place[some], text.take(pa.array(some))
        own, more = self.rows.column("members").combine_chunks(), self.rows.column("more").to_numpy()
        reps = self.rows.column("rep").combine_chunks()
        # each member of a class with each text of its class's list
        sizes = np.where(more, 1, own.value_lengths().to_numpy())
        begin = own.offsets.to_numpy()[:-1]
        count = np.bincount(i, minlength=len(sizes))
        start = np.cumsum(count) - count
        member = np.repeat(np.arange(len(sizes)), sizes)
        nth = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pair = np.repeat(np.arange(len(member)), count[member])
        at = np.arange(len(pair)) - np.repeat(np.cumsum(count[member]) - count[member], count[member]) + np.repeat(start[member], count[member])
        whose = member[pair]
        mine, other = own.values.take(pa.array((begin[member] + nth)[pair])), text.take(pa.array(at))
        keep_ = more[whose] | pc.not_equal(mine, other).to_numpy(zero_copy_only=False)
        pair, at, whose, mine, other = pair[keep_], at[keep_], whose[keep_], mine.filter(pa.array(keep_)), other.filter(pa.array(keep_))
        rank = np.arange(len(pair)) - np.searchsorted(pair, pair, side="left")
        some = np.flatnonzero(more[whose] | (rank < k))
        whose, unknown = whose[some], pa.array(more[whose[some]])
        none = pa.scalar(None, type=pa.string())
        text_id, rep = mine.take(pa.array(some)), reps.take(pa.array(whose))
        return pa.table([pa.array([self.grp] * len(some), type=pa.string()), pc.if_else(unknown, rep, none), pc.if_else(unknown, none, text_id), other.take(pa.array(some)), pa.array(sim[at[some]]), pa.array((rank[some] + 1).astype(np.int32))], names=["grp", "rep", "text_id", "neighbour", "similarity", "rank"])


FOUND = "grp string, rep string, text_id string, neighbour string, similarity double, rank int"


def _search(spark: SparkSession, index: Index, folder: str, k: int) -> DataFrame:
    """Rows of FOUND of all units; a task has one unit, or several where there are very many."""
    shared = spark.sparkContext.broadcast(index)
    units = sorted({(g, file) for (g, _), parts in index.parts.items() for file, _ in parts})
    names = spark.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("id").to_pylist():
                unit = _Unit(*names.value[n], shared.value, folder)
                unit.search()
                yield from unit.texts(k).to_batches(10_000)

    return spark.range(0, len(units), 1, min(len(units), MAX_TASKS)).mapInArrow(run, FOUND)


def nearest_texts(embeddings: DataFrame, k: int = NEIGHBOURS, exact: bool = False, probes: Callable[[int], int] = probes_for, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS) -> DataFrame:
    """(model, revision, text_id, neighbour, similarity, rank): the k most similar other texts of each text.

    Similarity is the cosine rounded to six decimals, ties go to the smaller text_id. See
    ``usable_vectors`` for what is left out; a text alone in its group has no neighbour. ``probes``
    gives the number of lists to probe from the number of lists there are; ``exact`` probes every list
    that the triangle inequality leaves open and compares all columns, so nothing is missed.

    The vectors are written to ``spark.checkpoint.dir`` in files that Python tasks read themselves
    (pyarrow.fs), which are removed before this returns.
    """
    spark = embeddings.sparkSession
    with spent_shuffles(spark):
        classes, owner = vector_classes(cut(usable_vectors(embeddings)), k + 1)
        named = embeddings.groupBy(_group().alias("grp")).agg(F.first("model").alias("model"), F.first("revision").alias("revision"))
        if classes.isEmpty():
            found = spark.createDataFrame([], FOUND)
        else:
            index = fit_index(classes, list_size, max_lists)
            index.probes = {g: len(c) if exact else probes(len(c)) for g, c in index.centres.items()}
            index.epsilon, index.keep = math.inf if exact else EPSILON, k + 1
            folder = f"{shared_folder(spark)}/vectors-{uuid4().hex}"
            try:
                listed = cut(assign(classes, index), classes)
                store(listed, index, folder)
                release(listed)
                found = cut(_search(spark, index, folder, k))
            finally:
                remove(spark, folder)
        alone = found.where(F.col("rep").isNull()).drop("rep")
        others = found.where(F.col("rep").isNotNull()).groupBy("grp", "rep").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("neighbour").alias("t"), F.col("similarity").alias("s")))).alias("near"))
        mine = owner.join(others, ["grp", "rep"]).withColumn("near", F.slice(F.filter("near", lambda x: x["t"] != F.col("text_id")), 1, k))
        crowd = mine.select("grp", "text_id", F.posexplode("near").alias("rank", "x")).select("grp", "text_id", F.col("x.t").alias("neighbour"), F.col("x.s").alias("similarity"), F.col("rank") + 1)
        return alone.union(crowd).join(F.broadcast(cut(named)), "grp").select("model", "revision", "text_id", "neighbour", "similarity", "rank")


def similar_pairs(embeddings: DataFrame, exact: bool = False) -> DataFrame:
    """(model, revision, text_a, text_b), text_a < text_b: pairs in which one is among the most similar of the other."""
    found = nearest_texts(embeddings, exact=exact)
    return found.select("model", "revision", F.least("text_id", "neighbour").alias("text_a"), F.greatest("text_id", "neighbour").alias("text_b")).distinct()
