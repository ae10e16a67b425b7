"""N-gram Jaccard join: documents whose sets of word shingles overlap enough.

Two sets with Jaccard similarity of at least ``percent`` share all but a few shingles,
so some must be shared in a prefix of each in one global order. Shingles of few
documents come first and are indexed one by one. Those of many documents, a class of
bounded size found by counting all of them, come last and are indexed by pairs: with
l of them in a prefix, dealt into parts, sharing no pair in any part means lacking all
but one a part, so the prefix is extended by one shingle a part. The number of parts
grows with the size of the set, which keeps pairs in proportion to the prefix; sets of
neighbouring size levels are indexed under both levels.

A pair's count of shared rare shingles bounds what the rest of the sets can share, which
drops most candidates that only have a passage in common. The others are verified on
the whole sets, against hubs first: those linked through a
hub are one component and need no further test, so a large group of copies costs a
test a member. Signatures that many sets in different components still share get rounds with
several hubs each, as long as these settle many of their pairs. Then all candidates still in different components are tested.

A document of fewer words than a shingle is one shorter shingle. Null and empty texts,
or texts without words, have no set and stay alone. Equal sets are one set throughout;
rows with the same doc_id are judged by their texts and share the id. Null ids come
back as null and sort first. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxrank.llm.arrays import NOT_SPACE, mix, prefix_sums, sequence_hashes, slices, window_hashes, words
from ctxrank.llm.components import components
from ctxrank.llm.tables import joinable
from ctxrank.session import stage, staging

WORDS = 4
PERCENT = 85
# The class of frequent shingles has at most FREQUENT members, whatever the corpus: those
# with at least one in FREQUENT of all shingles of all sets, and at least MIN_COUNT.
FREQUENT = 1 << 23
MIN_COUNT = 16
COUNTED = 1 << 21
GROUP = 256
BUCKET_BYTES = 4 << 20
JOIN_BYTES = 32 << 20
STAR_ROUNDS = 3
# Signatures of more than CROWD sets get rounds of HUBS hubs each, as long as a round settles
# a share of at least one in GAIN of the pairs that they leave to the last step. A round reads
# the whole index, so none is made for fewer pairs than the index has entries.
CROWD = 64
HUBS = 16
GAIN = 8
NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every row in falling order of nothing but their hash: (row, hash)."""
    starts, ends, row_of = words(data, rows)
    hashes = window_hashes(prefix_sums(data, fold_case=True), starts, ends)
    shingles = sequence_hashes(hashes, k)
    whole = row_of[: len(shingles)] == row_of[k - 1 :] if len(shingles) else np.zeros(0, bool)
    owner, value = row_of[: len(shingles)][whole], shingles[whole]
    sizes = np.bincount(row_of, minlength=len(rows) - 1)
    for size in range(1, k):
        short = np.flatnonzero(sizes == size)
        if len(short):
            first = np.searchsorted(row_of, short)
            owner = np.concatenate([owner, short])
            value = np.concatenate([value, sequence_hashes(hashes, size)[first]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _sums(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each row's set."""
    first = np.searchsorted(owner, np.arange(n + 1))
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    size = np.diff(first)
    return size, mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")


def set_sizes(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc, text_key, n, sid) of every row: how many shingles its set has, and the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in slices(batch.column(1)):
                size, sid = _sums(*shingle_sets(data, rows, k), end - first)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(size.astype(np.int64)), pa.array(sid.view(np.int64))],
                    names=["doc", "text_key", "n", "sid"],
                )

    rows = _rows(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc long, text_key long, n long, sid long")


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers and their counts as compressed differences, byte planes apart."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.concatenate([steps, counts.astype(np.uint64)]).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(4, "little") + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[4:]), np.uint8).reshape(8, 2 * n)
    both = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(both[:n]), both[n:]


def frequent_shingles(rows: DataFrame, total: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, counts, bits): the leading ``bits`` of the hash of every frequent shingle, sorted.

    All shingles of all sets are counted; the tasks exchange them sorted and packed,
    a range of the numbers each.
    """
    bits = max(32, int(32 * max(total, 1)).bit_length())
    ranges = 1 << max(0, int(total // COUNTED)).bit_length()
    least = max(MIN_COUNT, -(-total // FREQUENT))

    def packed(values: list[np.ndarray]) -> pa.RecordBatch:
        number, count = np.unique(np.concatenate(values), return_counts=True)
        part = number >> np.uint64(bits - ranges.bit_length() + 1)
        cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        blobs = [_pack(number[cuts[r] : cuts[r + 1]], count[cuts[r] : cuts[r + 1]]) for r in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "packed"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                _, value = shingle_sets(data, offsets, k)
                held.append(value >> np.uint64(64 - bits))
                size += len(value)
                if size >= COUNTED:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def count(table: pa.Table) -> pa.Table:
        parts = [_unpack(p.as_py()) for p in table.column("packed")]
        number, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
        often = counts >= least
        return pa.table({"number": number[often].view(np.int64), "n": counts[often]})

    found = rows.mapInArrow(scan, "part long, packed binary").groupBy("part").applyInArrow(count, "number long, n long")
    table = found.toArrow().sort_by("number")
    return table.column("number").to_numpy().view(np.uint64), table.column("n").to_numpy(), bits


def _levels(limit: int = 1 << 40, percent: int = PERCENT) -> np.ndarray:
    """First size of each level; sets that can link are at most one level apart."""
    sizes = [1]
    while sizes[-1] < limit:
        sizes.append(100 * sizes[-1] // percent + 1)
    return np.array(sizes)


def _pairs(value: np.ndarray, needed: int, own: int, size: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the frequent shingles of one set, given in the global order, and which are its own.

    ``needed`` more shingles must be lacking than the rare ones cover, ``own`` more for
    the shorter prefix that the smaller set of a pair needs.
    """
    parts = max(1, size // 53)
    part = (mix(value + np.uint64(level)) % np.uint64(parts)).astype(np.int64)
    _, first = np.unique(part, return_index=True)
    counts = np.ones(len(value), np.int64)
    counts[first] = 0
    lacking = np.cumsum(counts)
    stop = int(np.searchsorted(lacking, needed)) + 1
    place = np.arange(len(value))[:stop]
    stop_own = int(np.searchsorted(lacking, own)) + 1 if own > 0 else 0
    value, part = value[:stop], part[:stop]
    order = np.lexsort((value, part))
    value, part, place = value[order], part[order], place[order]
    made, mine, gap = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], 1
    while gap < len(value):
        same = part[gap:] == part[:-gap]
        if not same.any():
            break
        made.append(mix(value[:-gap][same] * np.uint64(0x2545F4914F6CDD1D) + value[gap:][same] + np.uint64(level)))
        mine.append(np.maximum(place[:-gap], place[gap:])[same] < stop_own)
        gap += 1
    return np.concatenate(made), np.concatenate(mine)


def signatures(
    owner: np.ndarray, value: np.ndarray, n: int, numbers: np.ndarray, counts: np.ndarray, bits: int, levels: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, own, rare by row) of every set that another, different set could link with.

    A set is indexed by a long prefix for smaller partners and, within it, by its own
    shorter one for partners that are not smaller. ``rare`` counts the single shingles of
    the long prefix. Signatures of single shingles are even, those of pairs odd.
    """
    first = np.searchsorted(owner, np.arange(n + 1))
    size = np.diff(first)
    needed = size - (percent * size + 99) // 100 + 1
    needed_own = size - (2 * percent * size + 99 + percent) // (100 + percent) + 1
    # Smaller sets that are not equal lack too much.
    alone = 100 * size < percent * (size + 1)
    needed[alone] = needed_own[alone] = 0
    number = value >> np.uint64(64 - bits)
    if len(numbers):
        at = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
        frequent = numbers[at] == number
    else:
        at, frequent = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
    rare = np.flatnonzero(~frequent)
    before = np.searchsorted(owner[rare], np.arange(n + 1))
    n_rare = np.diff(before)
    nth = np.arange(len(rare)) - before[owner[rare]]
    short = nth < needed[owner[rare]]
    chosen = rare[short]
    out_row, out = [owner[chosen]], [mix(value[chosen] + np.uint64(1)) & ~np.uint64(1)]
    out_own = [nth[short] < needed_own[owner[chosen]]]
    for row in np.flatnonzero(needed > n_rare):
        mine = np.arange(first[row], first[row + 1])
        mine = mine[frequent[mine]]
        mine = mine[np.lexsort((value[mine], counts[at[mine]]))]
        level = int(np.searchsorted(levels, size[row], "right")) - 1
        for l in {level, max(level - 1, 0)}:
            lack, lack_own = int(needed[row] - n_rare[row]), int(needed_own[row] - n_rare[row])
            made, own = _pairs(value[mine], lack, lack_own if l == level else 0, int(levels[l]), l)
            out_row.append(np.full(len(made), row))
            out.append(made | np.uint64(1))
            out_own.append(own)
    return np.concatenate(out_row), np.concatenate(out), np.concatenate(out_own), np.minimum(n_rare, needed)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by signature, the rows of signatures that more than one set has.

    The first and the last signature may go on in another partition and stay as well.
    """
    held: pa.Table | None = None
    held_often = False
    first_sig = None

    def chosen(rows: pa.Table, flags: np.ndarray) -> list[pa.RecordBatch]:
        return rows.filter(pa.array(flags)).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        sig, sid = rows.column("sig").to_numpy(), rows.column("sid").to_numpy()
        again = np.zeros(len(sig), bool)
        again[1:] = (sig[1:] == sig[:-1]) & (sid[1:] == sid[:-1])
        rows, sig = rows.filter(pa.array(~again)), sig[~again]
        first_sig = sig[0] if first_sig is None else first_sig
        same = sig[1:] == sig[:-1]
        often = np.zeros(len(sig), bool)
        often[1:] |= same
        often[:-1] |= same
        often |= sig == first_sig
        often[0] |= held_often
        # The last row waits for its successor, which may have its signature or be its copy.
        held, held_often = rows.slice(len(sig) - 1), bool(often[-1])
        often[-1] = False
        yield from chosen(rows, often)
    if held is not None:
        yield from held.combine_chunks().to_batches()


def shared_signatures(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray, int], k: int, percent: int) -> DataFrame:
    """(sig, sid, n, rare, own): the index entries of signatures that more than one set has."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    levels = _levels(percent=percent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts, bits = shared.value
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                owner, value = shingle_sets(data, offsets, k)
                size, sid = _sums(owner, value, end - first)
                row, sig, own, rare = signatures(owner, value, end - first, numbers, counts, bits, levels, percent)
                longs = [sig.view(np.int64), sid.view(np.int64)[row], size[row].astype(np.int32), rare[row].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, longs), pa.array(own)], names=["sig", "sid", "n", "rare", "own"])

    entry = "sig long, sid long, n int, rare int, own boolean"
    entries = rows.mapInArrow(scan, entry)
    sorted_entries = entries.repartitionByRange("sig", "sid").sortWithinPartitions("sig", "sid")
    return sorted_entries.mapInArrow(_shared, entry)


def _least(hub_n: str, percent: int) -> str:
    """How many shingles sets of ``n`` and ``hub_n`` must share."""
    return f"(({percent} * (n + {hub_n}) + {99 + percent}) div {100 + percent})"


def _can_link(percent: int) -> tuple[str, str]:
    """Two conditions on a pair: on the sizes n >= hub_n, and on ``both``, its shared single shingles.

    Sets as large as these must share ``least`` shingles. Of the single shingles in the long
    prefix of the larger and the short one of the smaller, those of the prefix that ends
    first lie wholly before the end of the other, so all that the sets share of them is
    counted, and what they lack must leave enough. A prefix that reaches into the frequent
    class holds all single shingles of its set and ends last.
    """
    least = _least("hub_n", percent)
    needed = f"(n - ({percent} * n + 99) div 100 + 1)"
    needed_own = f"(hub_n - ({2 * percent} * hub_n + {99 + percent}) div {100 + percent} + 1)"
    larger = f"(rare - both <= n - {least})"
    smaller = f"(least(hub_rare, {needed_own}) - both <= hub_n - {least})"
    shared = (
        f"case when rare < {needed} and hub_rare < {needed_own} then {larger} and {smaller}"
        f" when rare < {needed} then {smaller} when hub_rare < {needed_own} then {larger}"
        f" else {larger} or {smaller} end"
    )
    return f"100 * hub_n >= {percent} * n", shared


def _counted(pairs: DataFrame, percent: int) -> DataFrame:
    sizes, shared = _can_link(percent)
    counts = pairs.where(sizes).groupBy("sid", "hub").agg(
        F.count("*").alias("together"),
        F.count_if(F.col("sig") % 2 == 0).alias("both"),
        *[F.first(c).alias(c) for c in ("n", "hub_n", "rare", "hub_rare")],
    )
    return counts.where(shared)


def _hub(name: str):
    return F.col(name).alias(f"hub_{name}" if name != "sid" else "hub")


def _larger_first(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes and counts of single shingles stand as ``_can_link`` expects them."""
    turned = F.col("n") < F.col("hub_n")
    sizes = {c: F.when(turned, F.col(f"hub_{c}")).otherwise(F.col(c)) for c in ("n", "rare")}
    sizes |= {f"hub_{c}": F.when(turned, F.col(c)).otherwise(F.col(f"hub_{c}")) for c in ("n", "rare")}
    return pairs.withColumns(sizes)


def _star_pairs(shared: DataFrame, seed: int, percent: int) -> DataFrame:
    """For each set the one hub, of its signatures' hubs in other components, with which it shares most.

    Two of three rounds take hubs from the largest component, which gathers what is left
    of large groups; the others from any. Rounds save tests, they need not find all links.
    """
    first = F.xxhash64("comp", F.lit(seed)) if seed % 3 == 0 else -F.col("members")
    hub = F.min(F.struct(first.alias("first"), F.xxhash64("sid", F.lit(seed)).alias("then"), "sid", "n", "rare", "comp"))
    hubs = shared.groupBy("sig").agg(hub.alias("h")).select("sig", "h.*").select("sig", *map(_hub, ("sid", "n", "rare", "comp")))
    pairs = shared.join(hubs, "sig").where("comp <> hub_comp")
    best = _counted(_larger_first(pairs), percent).groupBy("sid").agg(F.max(F.struct("together", "hub")).alias("best"))
    return best.select("sid", F.col("best.hub").alias("hub"))


def _crowds(shared: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The signatures of many sets, their entries, the pairs they have between components, and those the last step meets.

    That step joins a set only with those indexed by their own prefix, and two of these once.
    """
    parts = shared.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
    pairs = {"n": "n * n / 2", "met": "n * own - own * own / 2"}
    inside = [F.sum(F.expr(pair)).alias(f"{name}_inside") for name, pair in pairs.items()]
    sums = parts.groupBy("sig").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), *inside)
    crowds = stage(sums.where(f"n > {CROWD} and n * n / 2 > n_inside"))
    between = [F.sum(F.expr(f"{pair} - {name}_inside")) for name, pair in pairs.items()]
    return crowds.select("sig"), *(int(x or 0) for x in crowds.agg(F.sum("n"), *between).first())


def _crowd_pairs(shared: DataFrame, crowds: DataFrame, seed: int, percent: int) -> DataFrame:
    """For each set of a crowded signature the hubs, of ``HUBS`` a signature, with which it shares most.

    Hubs come from the largest component, those with few single shingles of their own first, as
    they are nearest to what the crowd has in common; the hash changes them from round to round.
    """
    crowded = shared.join(crowds, "sig", "left_semi")
    apart = F.col("rare") + F.pmod(F.xxhash64("sid", F.lit(seed)), F.lit(16))
    place = Window.partitionBy("sig").orderBy(F.col("members").desc(), "comp", apart, "sid")
    hubs = crowded.withColumn("place", F.row_number().over(place)).where(f"place <= {HUBS}")
    pairs = crowded.join(hubs.select("sig", *map(_hub, ("sid", "n", "rare", "comp"))), "sig").where("comp <> hub_comp")
    best = Window.partitionBy("sid").orderBy(F.col("together").desc(), F.xxhash64("hub", F.lit(seed)), "hub")
    counts = _counted(_larger_first(pairs), percent)
    return counts.withColumn("place", F.row_number().over(best)).where(f"place <= {HUBS}").select("sid", "hub")


def _all_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Every pair of sets in different components that can link by the signatures they share.

    A pair that cannot link without a shared single shingle is met under that one, so pairs of
    frequent shingles bring together only those that can.
    """
    other = shared.where("own").select("sig", *map(_hub, ("sid", "n", "rare", "comp")))
    order = "(hub_n < n or hub_n = n and hub < sid) and comp <> hub_comp"
    sizes, linked = _can_link(percent)
    alone = linked.replace("- both", "- 0")
    met = f"{order} and {sizes} and (sig % 2 = 0 or {alone})"
    return _counted(shared.join(other, "sig").where(met), percent).select("sid", "hub")


def _still_open(known: DataFrame, percent: int) -> DataFrame:
    """The entries of signatures of several components that a pair may still need.

    Under a pair of frequent shingles sets meet one that is indexed by its own prefix; a set with more
    single shingles than even the smallest of these leaves room for needs another signature.
    """
    ends = [F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.when(F.col("own"), F.col("n"))).alias("smallest")]
    mixed = known.groupBy("sig").agg(*ends).where("low <> high").select("sig", "smallest")
    needed = f"sig % 2 = 0 or own or rare <= n - {_least('smallest', percent)}"
    return known.join(mixed, "sig").where(needed).drop("smallest")


def verified(docs: DataFrame, pairs: DataFrame, kinds: DataFrame, k: int, percent: int, join_bytes: int) -> DataFrame:
    """The pairs (sid, hub) whose whole sets overlap enough."""
    counts = pairs.groupBy("hub").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / GROUP)
    members = pairs.join(counts, "hub").select("sid", "hub", F.pmod(F.xxhash64("sid"), parts).cast("int").alias("part"))
    hubs = counts.select(F.col("hub").alias("sid"), "hub", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"))
    sent = members.withColumn("is_hub", F.lit(False)).unionByName(hubs.withColumn("is_hub", F.lit(True)))
    sent = stage(sent.join(kinds.select("sid", "least", F.col("n").alias("size")), "sid"))
    total = sent.agg(F.sum(F.col("size") * 8)).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    sent = sent.withColumn("bucket", F.pmod(F.xxhash64("hub", "part"), F.lit(buckets)))
    columns = ["sid", "hub", "part", "is_hub", "bucket"]
    wanted = sent.groupBy(F.col("least").alias("doc")).agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    side = joinable(stage(wanted), join_bytes)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in slices(batch.column(0)):
                owner, value = shingle_sets(data, rows, k)
                _, sid = _sums(owner, value, end - first)
                at = np.searchsorted(owner, np.arange(end - first + 1))
                for i, entries in enumerate(batch.column(1).slice(first, end - first)):
                    mine = entries.values.filter(pa.array(entries.values.field("sid").to_numpy() == sid.view(np.int64)[i]))
                    # A hub goes to many groups; a batch holds some of its copies.
                    content = value[at[i] : at[i + 1]].tobytes()
                    step = max(1, BUCKET_BYTES // (len(content) + 1))
                    for low in range(0, len(mine), step):
                        some = mine.slice(low, step)
                        yield pa.RecordBatch.from_arrays(
                            [*some.flatten(), pa.array([content] * len(some), pa.binary())], names=[*columns, "content"]
                        )

    def compare(table: pa.Table) -> pa.Table:
        is_hub = table.column("is_hub").to_numpy()
        keys = list(zip(table.column("hub").to_pylist(), table.column("part").to_pylist()))
        contents = table.column("content")
        hub_at = {keys[i]: i for i in np.flatnonzero(is_hub)}
        found, last, hub_set = [], None, np.zeros(0, np.uint64)
        for i in sorted(np.flatnonzero(~is_hub), key=lambda i: keys[i]):
            if keys[i] != last:
                last = keys[i]
                hub_set = np.frombuffer(contents[hub_at[last]].as_py(), np.uint64)
            mine = np.frombuffer(contents[i].as_py(), np.uint64)
            at = np.minimum(np.searchsorted(hub_set, mine), len(hub_set) - 1)
            both = int((hub_set[at] == mine).sum())
            if 100 * both >= percent * (len(mine) + len(hub_set) - both):
                found.append(i)
        links = table.select(["sid", "hub"]).take(pa.array(found, pa.int64()))
        return links.cast(pa.schema([("sid", pa.int64()), ("hub", pa.int64())]))

    kind = "sid long, hub long, part int, is_hub boolean, bucket long, content binary"
    sets = _rows(docs).join(side, "doc").select("text", "wanted").mapInArrow(fetch, kind)
    return sets.groupBy("bucket").applyInArrow(compare, "sid long, hub long")


def grouped(docs: DataFrame, k: int, percent: int, join_bytes: int) -> DataFrame:
    """(doc, text_key, n, group, component) of every row; ``NO_ID`` stands for a null id.

    ``group`` tells components apart, also where they share their smallest id; it is null
    for a row without a set. What a round has staged is deleted when the next one begins.
    """
    with staging(docs.sparkSession) as keep_only:
        sets = stage(set_sizes(docs, k))
        kinds = stage(sets.where("n > 0").groupBy("sid").agg(F.min("doc").alias("least"), F.max("n").alias("n"), F.count("*").alias("rows")))
        total = kinds.agg(F.sum("n")).first()[0] or 0
        copies = sets.join(kinds.where("rows > 1").select("sid", "least"), "sid").where("doc <> least").select("doc").distinct()
        # A row goes on if it is the first of its kind; an id of several rows goes on whole.
        several = sets.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
        skipped = stage(copies.join(several, "doc", "left_anti"))
        rows = _rows(docs).join(joinable(skipped, join_bytes), "doc", "left_anti")
        shared = stage(shared_signatures(rows, frequent_shingles(rows, total, k), k, percent))

        labels: DataFrame | None = None
        open_rows = shared.withColumns({"comp": F.col("sid"), "members": F.lit(1).cast("long")})
        seed, progress, before = 0, True, None
        while True:
            star, last = seed < STAR_ROUNDS and progress, False
            if not star:
                crowds, entries, apart, met = _crowds(open_rows)
                last = apart <= HUBS * entries or before is not None and GAIN * (before - apart) < before
                last = last or met <= shared.count()
                before = apart
            if last:
                pairs = stage(_all_pairs(open_rows, percent))
            else:
                pairs = stage(_star_pairs(open_rows, seed, percent) if star else _crowd_pairs(open_rows, crowds, seed, percent))
            found = verified(docs, pairs, kinds, k, percent, join_bytes)
            new = stage(found.select(F.col("sid").alias("a"), F.col("hub").alias("b")))
            progress = seed < 2 or not new.isEmpty()
            labels = components(new if labels is None else labels.unionByName(new))
            if last:
                break
            seed += 1
            sizes = labels.groupBy(F.col("b").alias("comp")).agg((F.count("*") + 1).alias("members"))
            known = shared.join(labels, F.col("sid") == F.col("a"), "left").select("sig", "sid", "n", "rare", "own", F.coalesce("b", "sid").alias("comp"))
            left = _still_open(known, percent).join(sizes, "comp", "left")
            open_rows = stage(left.withColumn("members", F.coalesce("members", F.lit(1))))
            keep_only(sets, kinds, shared, labels, open_rows)
        named = kinds.join(labels, F.col("sid") == F.col("a"), "left").select("sid", "least", F.coalesce("b", "sid").alias("comp"))
        named = stage(named)
        first = named.groupBy("comp").agg(F.min("least").alias("component"))
        by_set = stage(named.join(first, "comp").select("sid", F.col("comp").alias("group"), "component"))
        keep_only(sets, by_set)
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return sets.join(joinable(by_set, join_bytes), "sid", "left").select("doc", "text_key", "n", "group", own.alias("component"))


def near_duplicates(
    docs: DataFrame, k: int = WORDS, percent: int = PERCENT, join_bytes: int = JOIN_BYTES
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    rows = grouped(docs, k, percent, join_bytes)
    return rows.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def first_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, join_bytes: int = JOIN_BYTES) -> DataFrame:
    """One row of ``docs`` per group: of the smallest id, and of its rows the one with the smallest text hash.

    Rows without a set belong to no group and stay.
    """
    judged = stage(grouped(docs, k, percent, join_bytes).where("n > 0"))
    key = ["doc", "text_key"]
    least = judged.groupBy("group").agg(F.min(F.struct(*key)).alias("least"))
    gone = judged.join(least, "group").where("doc <> least.doc or text_key <> least.text_key").select(*key).distinct()
    again = judged.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key)
    own = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(docs["text"])]
    on = lambda side: (own[0] == side["doc"]) & (own[1] == side["text_key"])
    gone, again = joinable(stage(gone), join_bytes), joinable(stage(again), join_bytes)
    left = docs.join(gone, on(gone), "left_anti")
    # Rows repeated as they are: one stays.
    others = [F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    one = left.join(again, on(again), "left_semi").groupBy("doc_id", "text").agg(*others)
    return left.join(again, on(again), "left_anti").unionByName(one.select(*docs.columns))
