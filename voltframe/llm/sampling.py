"""Distinct sampled segmentations: Gumbel top-k without replacement by perturbed best-first search over the piece lattice."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from voltframe.llm.common import documents
from voltframe.llm.token_counts import MODEL, pre_tokens, processor

SAMPLES = 2
ALPHA = 0.6
# Zipf's law with this shift turns merge ranks into piece probabilities.
ZIPF_SHIFT = 10.0
UNRANKED = -1e6
HELD_TYPES = 120_000

GOLDEN, MIX1, MIX2 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the 64-bit seeds alone (split-mix finish)."""
    z = seed + GOLDEN
    z = (z ^ (z >> np.uint64(30))) * MIX1
    z = (z ^ (z >> np.uint64(27))) * MIX2
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def truncated_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, given that they are at most ``most``; minus infinity where there is no mass."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        g = location - np.log(np.exp(location - most) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, g)


class _Pile:
    """An array that grows at its end; emptying it keeps its memory."""

    def __init__(self, dtype: str, width: int = 1):
        self.data = np.empty((1 << 16, width) if width > 1 else 1 << 16, dtype=dtype)

    def more(self, size: int, n: int) -> np.ndarray:
        """Room for ``n`` more rows after the first ``size``."""
        if size + n > len(self.data):
            grown = np.empty((max(size + n, 2 * len(self.data)), *self.data.shape[1:]), dtype=self.data.dtype)
            grown[:size] = self.data[:size]
            self.data = grown
        return self.data[size : size + n]


class PrefixTable:
    """All beginnings of the pieces by a rolling hash, in two tables of which each key has a place in one.

    Looking up many strings at once is two gathers; what begins no piece need not be looked at any longer.
    """

    BITS = 19
    NONE = 1 << 40

    def __init__(self, pieces: dict[str, int]):
        prefixes: dict[int, int] = {}
        for text, number in pieces.items():
            h = 0
            for at, c in enumerate(text):
                h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes[h] = number if at + 1 == len(text) else prefixes.get(h, self.NONE)
        self.cells = np.zeros((2, 1 << self.BITS, 2), dtype=np.uint64)  # key and value side by side
        self.cells[:, :, 1] = self.NONE
        for key, value in prefixes.items():
            side = 0
            for _ in range(500):  # cuckoo hashing: what is pushed out goes to its place in the other table
                at = int(self.place(np.array([key], dtype=np.uint64), side)[0])
                pushed = self.cells[side, at].tolist()
                self.cells[side, at] = key, value
                key, value = pushed
                if key == 0:
                    break
                side = 1 - side
            else:
                raise RuntimeError("the prefix table is too small for this model")

    def place(self, h: np.ndarray, side: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * (MIX1 if side == 0 else MIX2)) >> np.uint64(64 - self.BITS)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each string begins a piece, and the piece it is, or -1."""
        cell = self.gather(0, h)
        begun = cell[:, 0] == h
        other = np.flatnonzero(~begun)
        cell[other] = self.gather(1, h[other])
        begun[other] = cell[other, 0] == h[other]
        return begun, np.where(begun & (cell[:, 1] != self.NONE), cell[:, 1].astype(np.int64), -1)

    def gather(self, side: int, h: np.ndarray) -> np.ndarray:
        """The cells of the strings in one table, moved as 16-byte items."""
        return self.cells[side].view(np.complex128)[:, 0][self.place(h, side)].view(np.uint64).reshape(-1, 2)


class Lattices:
    """Lattices of pre-tokens, built once per worker: nodes are places between characters, edges the pieces that fit.

    A piece has the probability that Zipf's law gives its merge rank, to the power ``alpha``. A character without a
    piece has one edge for its bytes. Each edge holds the probability of going on with it, from exact sums over all ways to
    the end: these sums are the bounds of the search. The edges of a node follow each other by length.
    """

    def __init__(self, model_path: str, alpha: float):
        model = processor(model_path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        rank = np.array([-s if (s := model.get_score(i)) > UNRANKED else 0.0 for i in range(size)])
        usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(size)])
        weight = -np.log(rank + ZIPF_SHIFT)
        norm = np.log(np.exp(weight[usable]).sum())
        self.weights = (alpha * (weight - norm)).astype(np.float32)
        self.byte_weight = alpha * float(-np.log(size + ZIPF_SHIFT) - norm)
        self.byte_ids = {bytes([b]): model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        text_of = [p.replace("▁", " ").encode() for p in self.pieces]
        for value, k in self.byte_ids.items():
            text_of[k] = value
        # The texts of all pieces one after the other, and where each lies.
        self.text = np.frombuffer(b"".join(text_of), dtype=np.uint8)
        self.text_size = np.array([len(t) for t in text_of], dtype=np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        names = {self.pieces[i]: i for i in np.flatnonzero(usable).tolist()}
        self.width = max(map(len, names))
        if self.width > 64:
            raise ValueError("a piece of this model is longer than 64 characters")
        self.table = PrefixTable(names)
        # By node: its first edge (-1 at an end) and the character; by edge: the node it leads to, its length, piece and chance.
        self.first, self.codes = _Pile("i8"), _Pile("u4")
        self.target, self.size, self.piece, self.chance = _Pile("i8"), _Pile("i1"), _Pile("i4"), _Pile("f4")
        self.cum = _Pile("f4", -(-self.width // 8) * 8)  # whole eights, so that comparisons are counted as 64-bit words
        self.clear()

    def clear(self) -> None:
        self.types: dict[str, int] = {}
        self.nodes = self.edges = 0

    def starts(self, words: list[str]) -> np.ndarray:
        """Start node of each pre-token."""
        if len(self.types) > HELD_TYPES:
            self.clear()
        found = list(map(self.types.get, words))
        if None in found:
            gaps = [i for i, v in enumerate(found) if v is None]
            self._build(list({words[i] for i in gaps}))
            for i in gaps:
                found[i] = self.types[words[i]]
        return np.fromiter(found, dtype=np.int64, count=len(found))

    def _build(self, words: list[str]) -> None:
        marked = [w if w[:1] == "\n" else "▁" * len(w) if not w.strip(" ") and w else "▁" + w.replace(" ", "▁") for w in words]
        # No piece holds a line end, so none reaches from one pre-token into the next.
        codes = np.frombuffer(("\n".join(marked) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        total, width = len(codes), self.width
        lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        left = np.repeat(begins + lengths, lengths + 1) - np.arange(total)  # characters to the end of the pre-token
        node = self.nodes
        self.codes.more(node, total)[:] = codes
        values = codes.astype(np.uint64) + np.uint64(1)
        alive = np.flatnonzero(left > 0)
        h = np.zeros(len(alive), dtype=np.uint64)
        fits = np.zeros(total, dtype=np.uint64)  # bit n - 1: a piece of n characters fits here
        edges: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in range(1, width + 1):
            h = h * np.uint64(0x100000001B3) + values[alive + n - 1]
            begun, found = self.table.find(h)
            whole = np.flatnonzero(found >= 0)
            rows, found = alive[whole], found[whole]
            edges.append((n, rows, found))
            fits[rows] |= np.uint64(1 << (n - 1))
            on = np.flatnonzero(begun & (left[alive] > n))
            alive, h = alive[on], h[on]
            if not len(alive):
                break
        order = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(int(left.max()) + 2))
        # Edges by level, node and length; a node without a one-character piece has the edge of its bytes instead.
        lone = np.flatnonzero((left > 0) & (fits & np.uint64(1) == 0))
        fits[lone] |= np.uint64(1)
        edges.append((1, lone, np.full(len(lone), -1, dtype=np.int32)))
        fan = np.bitwise_count(fits[order]).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(fan)))
        count = int(begin[-1])
        at = np.empty(total, dtype=np.int64)
        at[order] = begin[:-1]
        size, piece, chance, goal = (pile.more(self.edges, count) for pile in (self.size, self.piece, self.chance, self.target))
        for n, rows, found in edges:
            slot = at[rows] + np.bitwise_count(fits[rows] & np.uint64((1 << (n - 1)) - 1))
            size[slot], piece[slot] = n, found
        weight = self.weights[piece].astype(np.float64)
        weight[at[lone]] = [self.byte_weight * len(chr(c).encode("utf-8", "surrogatepass")) for c in codes[lone].tolist()]
        source = np.repeat(order, fan)
        target = source + size
        goal[:] = target + node
        self.first.more(node, total)[:] = np.where(left > 0, at + self.edges, -1)
        sums, share = np.zeros(total), np.empty(count)
        for r in range(1, int(left.max()) + 1):
            rows = slice(cuts[r], cuts[r + 1])
            lo, hi = begin[cuts[r]], begin[cuts[r + 1]]
            first = begin[rows] - lo
            w = weight[lo:hi] + sums[target[lo:hi]]
            top = np.maximum.reduceat(w, first)
            w = np.exp(w - np.repeat(top, fan[rows]))
            mass = np.add.reduceat(w, first)
            sums[order[rows]] = top + np.log(mass)
            share[lo:hi] = w / np.repeat(mass, fan[rows])
        chance[:] = share
        # Chances up to each edge of its node; the last edge takes all that is left.
        for k in range(1, int(fan.max())):
            further = begin[:-1][fan > k] + k
            share[further] += share[further - 1]
        share[begin[1:][fan > 0] - 1] = 2.0
        cum = self.cum.more(node, total)
        cum[:] = 2.0
        cum.reshape(-1)[source * cum.shape[1] + np.arange(count) - np.repeat(begin[:-1], fan)] = share
        self.edges += count
        self.nodes += total
        self.types.update(zip(words, (begins + node).tolist()))

    def log_probability(self, edges: np.ndarray) -> np.ndarray:
        return np.log(self.chance.data.take(edges).astype(np.float64))

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample a way to the end from each node; edges in order, and which node's way each belongs to."""
        owners, taken, step = [], [], 0
        lengths = np.zeros(len(nodes), dtype=np.int64)
        first, target, cum = self.first.data, self.target.data, self.cum.data
        edge = first.take(nodes)
        going = np.flatnonzero(edge >= 0)
        at, edge = nodes[going], edge[going]
        while len(going):
            u = uniform(seeds.take(going) + np.uint64(step)).astype(np.float32)
            edge += np.bitwise_count((u[:, None] > cum.take(at, axis=0)).view(np.uint64)).sum(axis=1, dtype=np.int64)
            owners.append(going)
            taken.append(edge)
            step += 1
            lengths[going] = step
            at = target.take(edge)
            edge = first.take(at)
            on = edge >= 0
            going, at, edge = going[on], at[on], edge[on]
        begins = np.cumsum(lengths) - lengths
        edges = np.empty(int(lengths.sum()), dtype=np.int64)
        for n, (rows, edge) in enumerate(zip(owners, taken)):
            edges[begins[rows] + n] = edge
        return np.repeat(np.arange(len(nodes)), lengths), edges

    def source(self, edge: int) -> int:
        return int(self.target.data[edge]) - int(self.size.data[edge])

    def options(self, node: int) -> list[int]:
        first = int(self.first.data[node])
        return [first + k for k in range(int((self.cum.data[node] < 2.0).sum()) + 1)]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids along a way; a character without piece gives the ids of its bytes."""
        pieces = self.piece.data.take(edges)
        lone = np.flatnonzero(pieces < 0)
        if not len(lone):
            return pieces.astype("<i4")
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in self.codes.data[self.target.data[edges[lone]] - 1].tolist()]
        room = np.ones(len(pieces), dtype=np.int64)
        room[lone] = [len(b) for b in spelt]
        out = np.repeat(pieces, room).astype("<i4")
        out[out < 0] = [self.byte_ids[bytes([v])] for b in spelt for v in b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; the space mark that the model puts first is left out."""
        size = self.text_size.take(ids)
        place = np.repeat(self.text_at.take(ids) - (np.cumsum(size) - size), size)
        place += np.arange(len(place))
        text = self.text.take(place).tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class _Way:
    """A sampled segmentation of each text of a batch, and the perturbed bounds of what it left aside at every step."""

    __slots__ = ("edges", "units", "bounds", "value", "log_p")

    def __init__(self, edges, units, bounds, value, log_p):
        self.edges, self.units, self.bounds, self.value, self.log_p = edges, units, bounds, value, log_p


def sample_ways(lattices: Lattices, texts: list[str], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations: (edges, log probability, perturbed value, log inclusion probability).

    The best perturbed value of all ways is one Gumbel variable; the first way is drawn from the model. What a way left aside at
    a step is a set of ways with known mass, whose best value is a Gumbel variable truncated at that of the whole. The search
    takes the set with the largest value next, draws a way from it and splits the rest of the set alike. So ways come by
    falling perturbed value, which is sampling without replacement; the value of the best set left after the
    k-th way gives the inclusion probabilities.
    """
    words = [pre_tokens(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    nodes = lattices.starts([w for ws in words for w in ws])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    seed = np.array(seeds, dtype=np.uint64)
    ways: list[list[_Way]] = [[] for _ in texts]
    barred: dict[tuple[int, int, int], list[int]] = {}

    def finish(rows: list[int], heads: list[np.ndarray], head_units: list[np.ndarray], froms: list[np.ndarray], units: list[np.ndarray], values: list[float], firsts: list[int], sample: int, extra: list[float]) -> None:
        """Draw the rest of the ways from their nodes on, and bound what they leave aside from step ``firsts`` on."""
        counts = np.array([len(f) for f in froms], dtype=np.int64)
        unit = np.concatenate(units) if units else np.zeros(0, dtype=np.int64)
        keys = np.repeat(seed[np.array(rows, dtype=np.int64)], counts) * MIX1 + (unit.astype(np.uint64) * np.uint64(k + 1) + np.uint64(sample)) * MIX2
        owner, edges = lattices.walk(np.concatenate(froms) if froms else unit, keys)
        ends = np.searchsorted(owner, np.cumsum(counts))
        begin = 0
        for i, row in enumerate(rows):
            tail, end = edges[begin : ends[i]], ends[i]
            way = np.concatenate([heads[i], tail])
            way_units = np.concatenate([head_units[i], unit[owner[begin:end]]])
            begin = end
            n, at = len(way), firsts[i]
            logq = lattices.log_probability(way)
            before = np.concatenate(([0.0], np.cumsum(logq)))[:-1]
            bounds = np.full(n, -np.inf)
            with np.errstate(divide="ignore"):
                location = before[at:] + np.where(logq[at:] < 0, np.log(-np.expm1(logq[at:])), -np.inf)
            if at < n and extra[i] is not None:
                location[0] = before[at] + extra[i]
            noise = uniform(seed[row : row + 1] * MIX2 + (np.arange(at, n, dtype=np.uint64) * np.uint64(k + 1) + np.uint64(sample)) * GOLDEN)
            bounds[at:] = truncated_gumbel(location, np.float64(values[i]), noise)
            ways[row].append(_Way(way, way_units, bounds, values[i], float(logq.sum())))

    root = -np.log(-np.log(uniform(seed * GOLDEN)))
    rows = [r for r in range(len(texts)) if sizes[r]]
    none = np.zeros(0, dtype=np.int64)
    finish(
        rows, [none] * len(rows), [none] * len(rows), [nodes[offsets[r] : offsets[r + 1]] for r in rows],
        [np.arange(sizes[r]) for r in rows], [float(root[r]) for r in rows], [0] * len(rows), 0, [None] * len(rows),
    )
    for sample in range(1, k):
        turn: tuple[list, ...] = tuple([] for _ in range(8))
        for r in rows:
            tops = [float(w.bounds.max()) if len(w.bounds) else -np.inf for w in ways[r]]
            p = int(np.argmax(tops))
            if np.isneginf(tops[p]) or len(ways[r]) < sample:
                continue
            way = ways[r][p]
            t = int(way.bounds.argmax())
            way.bounds[t] = -np.inf
            taken = barred.pop((r, p, t), [int(way.edges[t])])
            options = [e for e in lattices.options(lattices.source(int(way.edges[t]))) if e not in taken]
            chances = np.exp(lattices.log_probability(np.array(options)))
            u = float(uniform(np.array([int(seed[r]) ^ (sample << 32 | t)], dtype=np.uint64))[0])
            chosen = options[min(int(np.searchsorted(np.cumsum(chances), u * chances.sum())), len(options) - 1)]
            left = float(chances.sum() - chances[options.index(chosen)])
            unit = int(way.units[t])
            after = np.concatenate(([int(lattices.target.data[chosen])], nodes[offsets[r] + unit + 1 : offsets[r + 1]])).astype(np.int64)
            for column, value in zip(turn, (
                r, np.concatenate([way.edges[:t], [chosen]]), way.units[: t + 1], after, np.arange(unit, sizes[r]), tops[p], t,
                np.log(left) if len(options) > 1 and left > 0 else -np.inf,
            )):
                column.append(value)
            barred[(r, len(ways[r]), t)] = [*taken, chosen]
        if turn[0]:
            finish(*turn[:7], sample, turn[7])
    found = []
    for r in range(len(texts)):
        if not sizes[r]:
            found.append([(none, 0.0, float(root[r]), 0.0)])
            continue
        cut = max((float(w.bounds.max()) if len(w.bounds) else -np.inf) for w in ways[r])
        out = []
        for w in ways[r]:
            x = w.log_p - cut
            out.append((w.edges, w.log_p, float(w.value), 0.0 if np.isposinf(x) else x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))))
        found.append(out)
    return found


@lru_cache(maxsize=1)
def lattices_of(model_path: str, alpha: float) -> Lattices:
    return Lattices(model_path, alpha)


def _sampled(model_path: str, alpha: float, k: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model_path, alpha)
        for big in batches:
            for at in range(0, big.num_rows, 128):
                batch = big.slice(at, 128)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                seeds = [xxh64_intdigest(str(key)) for key in batch.column(2).to_pylist()]
                rows, out, pieces = [], [], []
                for row, (text, found) in enumerate(zip(texts, sample_ways(lattices, texts, seeds, k))):
                    plain = text.replace("▁", " ")
                    for sample, (edges, log_p, value, log_inclusion) in enumerate(found, 1):
                        ids = lattices.ids(edges)
                        rows.append(row)
                        out.append((sample, len(ids), log_p, value, log_inclusion, zlib.crc32(ids.tobytes()), lattices.decode(ids) == plain))
                        if keep_ids:
                            pieces.append(ids)
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, kinds))]
                names = ["id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "round_trip"]
                if keep_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def sample_segmentations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, alpha: float = ALPHA, model_path: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """Up to ``k`` distinct segmentations of every text, by falling perturbed log-probability.

    Columns: ``id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, round_trip`` and, if asked for, ``ids``. ``log_prob``
    is the log-probability of the segmentation among all of its text, ``log_inclusion`` that of being among the k. ``round_trip``
    tells that decoding gives the text (a literal space mark reads as a space). Random numbers follow from the id's
    value alone, so a row has the same samples in any partitioning; equal texts under other ids have others.
    Texts with fewer ways give all of them. Null and empty texts have one segmentation, without a piece.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("string").alias("_key"))
    kinds = {"sample": T.IntegerType(), "n_pieces": T.LongType(), "log_prob": T.DoubleType(), "perturbed": T.DoubleType(), "log_inclusion": T.DoubleType(), "ids_crc32": T.LongType(), "round_trip": T.BooleanType()}
    if keep_ids:
        kinds["ids"] = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, t) for c, t in kinds.items())])
    return rows.mapInArrow(_sampled(model_path or public_tokenizers.path(MODEL), alpha, k, keep_ids), schema)


def op3_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    return sample_segmentations(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
