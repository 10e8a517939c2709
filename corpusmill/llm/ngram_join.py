"""Exact Jaccard self-join on word n-gram sets with adaptive multi-match prefixes, and its connected components.

Sets are brought into one global order: rare shingles by hash, then frequent ones by estimated frequency. Two sets with
Jaccard similarity s or more share at least t = ceil(s * n) elements of either (n its size), so they share at least l of
the first n - t + l elements of both, for every l. A set takes the l (1 to 4) with the least estimated cost: the l-th
largest frequency in that prefix stands for its candidates, the added elements for the work of finding them. Of a pair,
the smaller l shared prefix elements are required before the sets are compared.

A posting list gives its pairs if they are few: a pair must also be able to reach the similarity with what stands after
the shared element in both sets. Lists that would give more than a few pairs a member (groups of near copies) do not:
their members are described anew by what parts them from one member, the list's hub. With d the size of that difference,
x and y link only if d(x) + d(y) - 2 * common <= K * (|x| + |y|), K = (1 - s) / (1 + s), where `common` counts the shared
elements of the two differences. If common = 0 is enough, both link with the hub, which is compared with all of them. Else
they share elements of prefixes of their differences, and the same step runs on lists of those. Each level costs one more
pass over the texts still in question; on the last one (LEVELS), lists give all the pairs that their bounds leave.

Only components are asked for: equal sets are one node, a first pass compares each node with its best partner and with
its lists' hubs, and later ones only what is still apart. Every pair is compared, in one component, or ruled out.

Frequencies only steer the order: tasks report shingles that they hold twice or more (COUNT_SHINGLES at a time); the most
frequent MAX_FREQUENT of their sums are sent to all tasks. Sets are of 64-bit hashes, equal sets have equal 64-bit sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import map_batches, map_stream, numbers, slices
from corpusmill.llm.graph import components
from corpusmill.llm.hashing import LOWER, gram_hashes, mix, signed, word_hashes, word_spans
from corpusmill.llm.lineage import dropped, swept, written
from corpusmill.llm.repeats import NULL_ID
from corpusmill.operators.joins import spread_join

#: Frequent shingles that are sent to all tasks: 16 bytes each, 16 MB at most.
MAX_FREQUENT = 1 << 20
#: Shingles that a task counts at a time.
COUNT_SHINGLES = 3_000_000
MAX_MATCHES = 4
#: Lists of so many members give their pairs at once; longer ones if there are at most so many pairs a member.
SHORT_LIST, FEW_PAIRS = 16, 8
#: Times that long lists are split by differences to a hub.
LEVELS = 3
#: Rows of a list that one task holds, and what a frequent shingle's list is dealt out in.
LIST_ROWS, PART_ROWS = 1 << 17, 2048
#: Members that are compared with one copy of their hub.
HUB_MEMBERS = 2000
#: Nodes whose texts are met by sending the nodes to all tasks (16 bytes each and their routes) instead of dealing out texts.
FEW_NODES = 50_000
#: What a shingle not known as frequent counts for, and how much rarer a further shared one makes a candidate.
RARE_COUNT, FURTHER = 4, 0.1
#: Pairs that a task tests at a time.
CELLS = 1 << 20


@dataclass(frozen=True)
class Join:
    """Shingles of `words` words; link where den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, n):
        """The least intersection that a set of n can have with a partner."""
        return -(-self.num * n // self.den)

    @property
    def whole(self) -> int:
        return self.den + self.num

    @property
    def part(self) -> int:
        """K is part / whole: two sets link where their difference is at most K times their sizes' sum."""
        return self.den - self.num


@dataclass
class Order:
    """The frequent shingles (sorted) and their estimated frequencies."""

    tokens: np.ndarray
    counts: np.ndarray

    def frequencies(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0).astype(np.int64)


def shingle_sets(flat: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text's whole word sequence is its one shingle."""
    flat = LOWER[flat]
    starts, ends, first = word_spans(flat, offs)
    hashes = word_hashes(flat, starts, ends)
    grams = gram_hashes(hashes, words)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        else:
            out.append(gram_hashes(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> int:
    """64 bits of a whole set, its size included."""
    own = mix(tokens * np.uint64(0x9E3779B97F4A7C15))
    total = (3 * int(own.sum(dtype=np.uint64)) + len(tokens)) % 2**64
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def ordered(tokens: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set in the global order, and its frequencies there."""
    freq = order.frequencies(tokens)
    if not freq.any():
        return tokens, freq
    at = np.lexsort((tokens, freq))
    return tokens[at], freq[at]


def matches_for(freq: np.ndarray, base: int) -> int:
    """How many shared prefix elements to require: the least estimated cost of candidates and of further elements."""
    best, least = 1, None
    for need in range(1, MAX_MATCHES + 1):
        if base + need - 1 > len(freq):
            break
        cost = float(np.maximum(freq[: base + need - 1], RARE_COUNT).sum()) * FURTHER ** (need - 1) + 2 * need
        if least is None or cost < least:
            best, least = need, cost
    return best


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def frequent_shingles(docs: DataFrame, join: Join) -> Order:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        held = 0

        def repeated() -> dict:
            token, n = np.unique(np.concatenate(parts), return_counts=True)
            return {"token": signed(token[n > 1]), "n": n[n > 1]}

        for batch in batches:
            for _, _, flat, offs in slices(batch.column(1)):
                for tokens in shingle_sets(flat, offs, join.words):
                    sign = signature(tokens)
                    if sign not in seen:
                        seen.add(sign)
                        parts.append(tokens)
                        held += len(tokens)
                if held >= COUNT_SHINGLES:
                    yield repeated()
                    seen, parts, held = set(), [], 0
        if parts:
            yield repeated()

    counted = map_stream(docs, count, "token long, n long")
    table = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    token, n = table.column("token").to_numpy().view(np.uint64), table.column("n").to_numpy()
    by = np.argsort(token)
    return Order(token[by], np.minimum(n[by], np.iinfo(np.int32).max).astype(np.int32))


def _prefix_rows(join: Join, sent):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        order = sent.value
        sizes, nodes, needs, prefixes, seen = [], [], [], [], set()
        for _, _, flat, offs in slices(batch.column(1)):
            for tokens in shingle_sets(flat, offs, join.words):
                n = len(tokens)
                sizes.append(n)
                if not n:
                    nodes.append(None), needs.append(None), prefixes.append(None)
                    continue
                node = signature(tokens)
                nodes.append(node)
                if node in seen:
                    needs.append(None), prefixes.append(None)
                    continue
                seen.add(node)
                tokens, freq = ordered(tokens, order)
                base = n - join.overlap(n) + 1
                need = matches_for(freq, base)
                needs.append(need)
                prefixes.append(tokens[: base + need - 1].tobytes())
        yield {"doc": batch.column(0), "n": sizes, "node": nodes, "need": needs, "prefix": prefixes}

    return run


POSTING_SCHEMA = "token long, salt int, node long, n int, d int, pos int, need int, label long"


def _postings(sent):
    """A node's prefix elements; those of frequent shingles are dealt out further."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        order = sent.value
        prefixes = batch.column(3).to_pylist()
        times = np.array([len(p) // 8 for p in prefixes], np.int64)
        token = np.frombuffer(b"".join(prefixes), np.uint64)
        node, n, need = (np.repeat(numbers(batch.column(i)), times) for i in (0, 1, 2))
        parts = order.frequencies(token) // PART_ROWS + 1
        salt = np.where(parts > 1, mix(node.astype(np.uint64)) % parts.astype(np.uint64) + np.uint64(1), 0)
        yield {"token": signed(token), "salt": salt, "node": node, "n": n, "d": n, "pos": _counting(times), "need": need, "label": node}

    return run


def _counting(times: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the times."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def _sizes_fit(join: Join, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * join.den >= np.maximum(n, m) * join.num


LIST_SCHEMA = "member boolean, token long, salt int, a long, b long, pos int, need int"
_COLUMNS = ("token", "salt", "node", "n", "d", "pos", "need", "label")


class Lists:
    """Turns the posting lists of a sorted partition into pairs and members of long lists.

    Of a pair whose first shared element stands at `pos`, at most r = d - pos elements of either are shared. x and y are
    tested by E(y) <= G(x) and E(x) <= G(y) with E = d * whole - n * part and G = 2 * whole * (r + need - 1) - E, which says
    that the smaller r, and what may have been shared before, reaches the least overlap.
    """

    def __init__(self, join: Join, last: bool) -> None:
        self.join, self.last = join, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[dict[str, np.ndarray]] = []
        size, spilled = 0, None  # a list of too many rows to hold goes on as members at once
        for batch in batches:
            a = {name: numbers(batch.column(i)) for i, name in enumerate(_COLUMNS)}
            if spilled is not None:
                own = (a["token"] == spilled[0]) & (a["salt"] == spilled[1])
                yield from self._members({k: x[own] for k, x in a.items()})
                a = {k: x[~own] for k, x in a.items()}
            if not len(a["token"]):
                continue
            cut = int(np.searchsorted(a["token"], a["token"][-1]))
            cut += int(np.searchsorted(a["salt"][cut:], a["salt"][-1]))
            spilled = None
            whole, rest = {k: x[:cut] for k, x in a.items()}, {k: x[cut:] for k, x in a.items()}
            if cut or (held and self._key(held[-1]) != self._key(rest)):
                yield from self._settled([*held, whole])
                held, size = [], 0
            held.append(rest)
            size += len(rest["token"])
            if size >= LIST_ROWS and not self.last:
                spilled = self._key(rest)
                for part in held:
                    yield from self._members(part)
                held, size = [], 0
        yield from self._settled(held)

    @staticmethod
    def _key(a: dict[str, np.ndarray]) -> tuple[int, int]:
        return int(a["token"][-1]), int(a["salt"][-1])

    def _settled(self, parts: list[dict[str, np.ndarray]]) -> Iterator[dict]:
        a = {k: np.concatenate([p[k] for p in parts]) for k in _COLUMNS} if parts else None
        if not a or not len(a["token"]):
            return
        dealt = a["salt"] > 0
        if dealt.any() and not self.last:
            yield from self._members({k: x[dealt] for k, x in a.items()})
            a = {k: x[~dealt] for k, x in a.items()}
        if not len(a["token"]):
            return
        new = np.ones(len(a["token"]), bool)
        new[1:] = (a["token"][1:] != a["token"][:-1]) | (a["salt"][1:] != a["salt"][:-1])
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(new)])
        n, d = a["n"].astype(np.int64), a["d"].astype(np.int64)
        e = d * self.join.whole - n * self.join.part
        g = 2 * self.join.whole * (d - a["pos"] + a["need"] - 1) - e
        for m in range(2, SHORT_LIST + 1):
            first = starts[size == m]
            i, j = np.triu_indices(m, 1)
            step = max(1, CELLS // len(i))
            for at in range(0, len(first), step):
                x, y = (first[at : at + step, None] + i).ravel(), (first[at : at + step, None] + j).ravel()
                yield from self._pairs(a, n, e, g, x, y)
        for k in np.flatnonzero(size > SHORT_LIST).tolist():
            yield from self._long(a, n, e, g, np.arange(starts[k], starts[k] + size[k]))

    def _long(self, a, n, e, g, at: np.ndarray) -> Iterator[dict]:
        if (a["label"][at] == a["label"][at[0]]).all():
            return
        at = at[np.argsort(e[at], kind="stable")]
        while len(at):  # members that no other one can be a partner of
            reach = np.searchsorted(e[at], g[at], side="right") - (e[at] <= g[at])
            back = len(at) - np.searchsorted(np.sort(g[at]), e[at]) - (g[at] >= e[at])
            stay = (reach > 0) & (back > 0)
            if stay.all():
                break
            at = at[stay]
        if not len(at):
            return
        if not self.last and min(int(reach.sum()), int(back.sum())) > 2 * FEW_PAIRS * len(at):
            yield from self._members({k: x[at] for k, x in a.items()})
            return
        ends = np.searchsorted(e[at], g[at], side="right")
        row = 0
        while row < len(at):
            step = max(1, CELLS // max(1, int(ends[row : row + 256].max())))
            own = np.arange(row, min(row + min(step, 256), len(at)))
            times = np.maximum(ends[own] - own - 1, 0)
            yield from self._pairs(a, n, e, g, at[np.repeat(own, times)], at[np.repeat(own + 1, times) + _counting(times)])
            row = int(own[-1]) + 1

    def _pairs(self, a, n, e, g, x: np.ndarray, y: np.ndarray) -> Iterator[dict]:
        ok = (e[x] <= g[y]) & (e[y] <= g[x]) & (a["label"][x] != a["label"][y]) & _sizes_fit(self.join, n[x], n[y])
        x, y = x[ok], y[ok]
        if k := len(x):
            u, v = a["node"][x], a["node"][y]
            yield {"member": np.zeros(k, bool), "token": np.zeros(k, np.int64), "salt": np.zeros(k, np.int32), "a": np.minimum(u, v), "b": np.maximum(u, v), "pos": np.zeros(k, np.int32), "need": np.minimum(a["need"][x], a["need"][y])}

    def _members(self, a: dict[str, np.ndarray]) -> Iterator[dict]:
        if k := len(a["token"]):
            yield {"member": np.ones(k, bool), "token": a["token"], "salt": a["salt"], "a": a["node"], "b": np.zeros(k, np.int64), "pos": a["pos"], "need": a["need"]}


def _routed_sets(join: Join, sent):
    """A node's set once for each place where it is compared."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        wanted, routes = batch.column(0).to_pylist(), batch.column(2)
        row = 0
        for _, _, flat, offs in slices(batch.column(1)):
            out: dict[str, list] = {n: [] for n in ("hub", "salt", "role", "node", "need", "tokens")}
            for tokens in shingle_sets(flat, offs, join.words):
                node, own = wanted[row], routes[row]
                row += 1
                if not len(tokens) or signature(tokens) != node:  # rows may share an id
                    continue
                data = ordered(tokens, sent.value)[0].tobytes()
                for r in own.as_py():
                    for n in ("hub", "salt", "role", "need"):
                        out[n].append(r[n])
                    out["node"].append(node)
                    out["tokens"].append(data)
                    if len(data) * len(out["tokens"]) > 1 << 22:
                        yield out
                        out = {n: [] for n in out}
            yield out

    return run


COMPARED_SCHEMA = "a long, b long, shared int, united int, n int, d int, prefix binary"


def _compare(join: Join, sent):
    """Intersection and union sizes of each hub with its members; null for pairs that share too few prefix elements. Where
    need is 0 the member is told by its difference to the hub: the difference's size and its prefix go out too.
    Over a partition sorted by (hub, salt, role), so a hub comes before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hub, x, x_freq = None, np.zeros(0, np.uint64), None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("a", "b", "shared", "united", "n", "d", "prefix")}
            for key, _, role, node, need, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0:
                    hub, x, x_freq = key, np.frombuffer(data, np.uint64), None
                    continue
                assert hub == key, "a hub's set is missing"
                y = np.frombuffer(data, np.uint64)
                p, q = (len(s) - join.overlap(len(s)) + need for s in (x, y))
                known = not need or len(np.intersect1d(x[:p], y[:q], assume_unique=True)) >= need
                common = d = prefix = None
                if known:
                    in_x = np.isin(y, x, assume_unique=True)
                    common = int(in_x.sum())
                    if not need:
                        d = len(x) + len(y) - 2 * common
                        size = difference_prefix(join, len(x), len(y), d)
                        added = y[~in_x][:size]
                        if len(added) < size:
                            x_freq = sent.value.frequencies(x) if x_freq is None else x_freq
                            gone = ~np.isin(x, y, assume_unique=True)
                            # What most members have is what few of them lack.
                            lacking = x[gone][np.lexsort((x[gone], -x_freq[gone]))][: size - len(added)]
                            added = np.concatenate([added, mix(~lacking)])
                        prefix = added.tobytes()
                out["a"].append(key)
                out["b"].append(node)
                out["shared"].append(common)
                out["united"].append(len(x) + len(y) - common if known else None)
                out["n"].append(len(y))
                out["d"].append(d)
                out["prefix"].append(prefix)
            yield out

    return run


def difference_prefix(join: Join, hub: int, n: int, d: int) -> int:
    """How many elements of a difference of size d (of a set of n to a hub of size `hub`) can be the first shared one.

    With a partner y of size m and difference e, at most (d - e + K * (n + m)) / 2 elements stand before it. If this set
    links with the hub, only partners that do not are of interest: e > K * (hub + m). If it does not link, m <= n / s
    bounds it, as do e > 0 and e >= d - K * (n + m) (else the sets differ by too much).
    """
    k, s = join.part / join.whole, join.num / join.den
    if d * join.whole <= join.part * (hub + n):
        bound = (d + k * (n - hub)) / 2
    else:
        most = k * (n + n / s)
        bound = min(most, (d + most) / 2)
    return max(0, min(d, int(bound + 1e-6) + 2))


def _compared(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, join: Join, sent, few: int) -> DataFrame:
    """Sizes for `few` pairs (a, b, need): each text is met once and its set goes to every hub that it is paired with.

    A hub with many members has a copy for each HUB_MEMBERS of them.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("salts"))
    member = pairs.join(salts, "a").select(F.col("b").alias("node"), F.struct(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "need").alias("r"))
    hub = salts.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hub = hub.select("node", F.struct(F.col("node").alias("hub"), "salt", F.lit(0).alias("role"), F.lit(0).alias("need")).alias("r"))
    routes = member.unionByName(hub).groupBy("node").agg(F.collect_list("r").alias("routes"))
    wanted = firsts.join(routes, "node")
    if few <= FEW_NODES:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "doc").select("node", "text", "routes")
    sets = map_batches(texts, _routed_sets(join, sent), "hub long, salt int, role int, node long, need int, tokens binary")
    dealt = sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return map_stream(dealt, _compare(join, sent), COMPARED_SCHEMA).dropDuplicates(["a", "b"])


def _difference_postings(batch: pa.RecordBatch) -> Iterator[dict]:
    """The prefix elements of differences, each with its hub one key."""
    hub, node, n, d, label = (numbers(batch.column(i)) for i in range(5))
    prefixes = batch.column(5).to_pylist()
    times = np.array([len(p) // 8 for p in prefixes], np.int64)
    token = np.frombuffer(b"".join(prefixes), np.uint64)
    key = mix(token ^ np.repeat(mix(hub.astype(np.uint64)), times))
    k = len(key)
    yield {"token": signed(key), "salt": np.zeros(k, np.int32), "node": np.repeat(node, times), "n": np.repeat(n, times), "d": np.repeat(d, times), "pos": _counting(times), "need": np.ones(k, np.int32), "label": np.repeat(label, times)}


def _listed(postings: DataFrame, join: Join, last: bool) -> DataFrame:
    return written(map_stream(postings.repartition("token", "salt").sortWithinPartitions("token", "salt"), Lists(join, last), LIST_SCHEMA))


def _with_hubs(lists: DataFrame) -> DataFrame:
    """(a, b, need = 0): members of long lists with their list's hub, the member that has the least before the element."""
    members = lists.where("member")
    parts = members.groupBy("token", "salt").agg(F.min(F.struct("pos", "a")).alias("h"))
    hubs = parts.groupBy("token").agg(F.min("h").alias("h"))
    placed = parts.select("token", "salt").join(hubs, "token").select("token", "salt", F.col("h.a").alias("hub"))
    return members.select("token", "salt", "a").join(placed, ["token", "salt"]).where("a <> hub").select(F.col("hub").alias("a"), F.col("a").alias("b"), F.lit(0).alias("need")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that are not in one component yet."""
    x = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    return x.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*pairs.columns)


def _difference_lists(found: DataFrame, labels: DataFrame, join: Join, last: bool) -> DataFrame:
    """The lists of the differences to those hubs whose members are apart."""
    told = found.where("d > 0").select(F.col("a").alias("hub"), F.col("b").alias("node"), "n", "d", "prefix")
    told = told.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_hubs = told.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("hub")
    left = told.join(open_hubs, "hub").select("hub", "node", "n", "d", "label", "prefix")
    return _listed(map_batches(left, _difference_postings, POSTING_SCHEMA), join, last)


def node_components(docs: DataFrame, table: DataFrame, join: Join, sent) -> DataFrame:
    """(node, label) of all nodes that link with another one."""
    nodes = table.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.max("need").alias("need"), F.max("prefix").alias("prefix"))
    firsts = table.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"))
    lists = _listed(map_batches(nodes.select("node", "n", "need", "prefix"), _postings(sent), POSTING_SCHEMA), join, False)
    linked = F.expr(f"shared * {join.den} >= united * {join.num}")
    counted = lists.where("not member").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need"))
    # Of what two sets share beyond short lists, the long lists' differences take care.
    short = written(counted.where("c >= need"))
    best = short.groupBy("b").agg(F.max(F.struct("c", "a", "need")).alias("k")).select("k.a", "b", "k.need")
    waiting = short.select("a", "b", "need")
    labels = docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("label"))
    tried = None
    due = best.unionByName(_with_hubs(lists))
    for level in range(1, LEVELS + 2):
        due = written(due.groupBy("a", "b").agg(F.min("need").alias("need")))
        dropped(lists)
        if not (n := due.count()):
            dropped(due)
            break
        found = written(_compared(due, docs, firsts, join, sent, n))
        dropped(due)
        seen = written(found.select("a", "b") if tried is None else tried.unionByName(found.select("a", "b")))
        dropped(tried)
        tried = seen
        links = found.where(linked).select("a", "b").unionByName(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        before, labels = labels, written(components(links))
        dropped(before)
        if level > LEVELS:
            dropped(found)
            break
        lists = _difference_lists(found, labels, join, level == LEVELS)
        pairs = lists.where("not member").select("a", "b", "need")
        if level == 1:
            pairs = pairs.unionByName(_apart(waiting, labels))
        due = pairs.join(tried, ["a", "b"], "left_anti")
        due = due.unionByName(_with_hubs(lists))
        dropped(found)
    dropped(short), dropped(tried)
    return labels


def similar_groups(df: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles and component_id (the smallest id that links reach) for each row.

    Texts without words (null and empty ones too) have no shingles, are linked with nothing and are components of their
    own. Repeated rows are repeated and share a component. Null ids stand last: they are a component's id only if all
    its ids are null. Words part at ASCII white space; A-Z count as a-z.
    """
    spark = df.sparkSession
    docs = _keyed(df, id_col, text_col)
    sent = spark.sparkContext.broadcast(frequent_shingles(docs, join))
    table = written(map_batches(docs, _prefix_rows(join, sent), "doc long, n int, node long, need int, prefix binary"))
    labels = node_components(docs, table, join, sent)
    swept(spark)
    own = table.select("doc", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.where("label is not null").groupBy("label").agg(F.min("doc").alias("component"))
    joined = spread_join(own.where("label is not null"), least, "label", by="doc")
    out = joined.unionByName(own.where("label is null").withColumn("component", F.col("doc")))
    null_id = lambda c: F.when(c != NULL_ID, c)
    out = written(out.select(null_id(F.col("doc")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null_id(F.col("component")).alias("component_id")))
    dropped(table), dropped(labels)
    return out
