"""N-gram Jaccard join: size-aware heavy-light join of word-shingle sets.

A document is the set of its distinct 5-word shingles (64-bit names).  Sets up to a boundary are *light*: for every size
a partner may have, they enumerate their subsets of the overlap that such a pair needs, and light sets that link meet
in a subset.  Larger sets are *heavy*: their rarest names are looked up in inverted lists.  If two sets have the
similarity, the first size - ceil(3/4 size) + 1 names of both, in one common order, share one.  The boundary is the
size up to which subsets cost less than lists, from the measured list length.

The order puts frequent names last, so lists of common passages are not scanned.  Frequent names are counted over all
documents; at most 2^18 are told apart, the rest are ordered by hash: the bound costs time, never a link.

Lists are not unfolded into pairs.  Each list links its members to its most central document (most of its names are
shared), these pairs are verified, and links are united.  Lists that then lie in one component are done.  In the others,
members of different components are compared in full, so no link between components is lost; only links within a
component stay unlisted.  Where a central document has few members, pairs are verified one by one, each in the first
list that shows it.  Where it has many, blocks of its members are compared inside tasks, which hand on a spanning forest
of the links: no pair that isn't one ever is a row.

Two things keep sets from travelling.  Documents of equal sets (128 bits decide) are represented by the smallest; the
rest get its component at the end.  And pairs are sifted by parity bitmaps before sets are sent: names are thrown into
2 to 4 bits each, a bit says whether an odd number fell on it, so two sets differ in at least as many names as their
bitmaps in bits.  Sets link when 7 * difference <= sum of sizes, so what the bitmaps refuse cannot link.

Cases: a null text or one without words has an empty set and links with nothing; with fewer than five words the whole
sequence is one shingle; rows of equal doc_id are one document, its set is the union of theirs and each row reports it
(the texts of one id are held by one task, as a long text is); a null doc_id links with nothing and has no component;
extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import exchange as X
from tidemark.llm.common import discard, free_shuffles, pieces, raw_bytes, written
from tidemark.llm.graph import components, extended
from tidemark.llm.hashing import WHITE, combine, lower_ascii, mix, runs, word_hashes

SHINGLE = 5
#: The similarity as a fraction: intersection / union >= 3 / 4.
NUM, DEN = 3, 4
#: Frequent names that the order tells apart at most, and how often a name must occur to be one.
FREQUENT, OFTEN = 1 << 18, 24
#: Largest size that may be light.
LIGHT_MOST = 12
#: Members of a central document that one task verifies, and how many make it compare by blocks.
STAR, MANY = 256, 48
#: Names that are multiplied at once when blocks are compared.
COLUMNS = 4096
#: Shares that what meets a common document or set is dealt to.
SHARES = 64
#: Stands between the texts of one doc_id: no text in UTF-8 holds this byte.
BREAK = 0xFF


def shingle_sets(body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle names of each row of a block; texts joined by BREAK give the union of their sets."""
    cut = np.flatnonzero(body == BREAK)
    if not len(cut):
        return _plain_sets(body, at)
    whole = np.delete(body, cut)
    row = np.searchsorted(at, cut, "right") - 1
    starts = np.sort(np.concatenate([at - np.searchsorted(cut, at), cut - np.arange(len(cut))]))
    sets = iter(_plain_sets(whole, starts))
    return [np.unique(np.concatenate([next(sets) for _ in range(1 + n)])) for n in np.bincount(row, minlength=len(at) - 1)]


def _plain_sets(body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    begin, end, first = runs(~WHITE[body], at)
    word = word_hashes(lower_ascii(body), begin, end)
    many = len(word) - SHINGLE + 1
    h = word[: max(many, 0)]
    for k in range(1, SHINGLE):
        h = combine(h, word[k : k + many]) if many > 0 else h
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            short = word[a]
            for k in range(a + 1, b):
                short = combine(short[None], word[k : k + 1])[0]
            out.append(mix(np.array([short], np.uint64) + np.uint64(b - a)))
        else:
            out.append(word[:0])
    return out


def parity(names: np.ndarray) -> bytes:
    """The parity bitmap of a set: a power of two of bits, 64 at least and two for each name at least."""
    many = max(64, 1 << (2 * len(names) - 1).bit_length())
    odd = np.bincount((mix(names) & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (last axis: 64-bit words) as they are with fewer bits."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def may_link(x: np.ndarray, n: int, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which of the sets of m names with bitmaps y (a row each) may link with the set of n names and bitmap x."""
    words = min(x.shape[-1], y.shape[-1])
    apart = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(-1, dtype=np.int64)
    return (NUM + DEN) * apart <= (DEN - NUM) * (n + m)


def overlap(s: int, t: int) -> int:
    """Names that sets of s and t names must share: intersection >= NUM / (NUM + DEN) * (s + t)."""
    return -(-NUM * (s + t) // (NUM + DEN))


def partners(s: int) -> range:
    """Sizes that a set of s names can be similar to."""
    return range(-(-NUM * s // DEN), s * DEN // NUM + 1)


def prefix(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def subsets(names: np.ndarray, most: int) -> np.ndarray:
    """Names of the subsets of a light set, for every light size that a partner may have."""
    s, out = len(names), []
    for t in partners(s):
        if t > most:
            continue
        c = overlap(s, t)
        tag = mix(np.array([min(s, t) << 40 | max(s, t) << 20 | c], np.uint64))
        picks = np.array(list(combinations(range(s), c)))
        h = np.repeat(tag, len(picks))
        for k in range(c):
            h = combine(h, names[picks[:, k]])
        out.append(h)
    return np.concatenate(out) if out else names[:0]


def subset_count(s: int, most: int) -> int:
    return sum(math.comb(s, overlap(s, t)) for t in partners(s) if t <= most and overlap(s, t) <= s)


def boundary(list_length: float) -> int:
    """The largest size whose subsets cost less than scanning lists of the given mean length."""
    light = 0
    for s in range(1, LIGHT_MOST + 1):
        if all(subset_count(k, s) <= prefix(k) * (1 + list_length) for k in range(1, s + 1)):
            light = s
    return light


def _rank(names: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The names in the common order: infrequent ones by hash, then frequent ones, rarest first.

    ``frequent`` holds names sorted by number, in its first row, and their place in the order, in its second.
    """
    if not frequent.shape[1]:
        return names
    spot = np.searchsorted(frequent[0], names)
    spot[spot == frequent.shape[1]] = 0
    known = frequent[0][spot] == names
    return np.concatenate([names[~known], names[known][np.argsort(frequent[1][spot[known]])]]) if known.any() else names


def frequent_names(docs: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """Names that are often in the beginning of a document's set, with their place by number; the mean list length."""

    def read(batches):
        for chunk, keys, prints, body, at in X.read_chunks(batches):
            heads = [s[: prefix(len(s))] for s in shingle_sets(body, at) if len(s)]
            names, counts = np.unique(np.concatenate(heads), return_counts=True) if heads else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield X.build_rows(list(X.to_buckets(chunk, names, bits, {}, key=names, count=counts.astype(np.uint32))))

    def total(table: pa.Table) -> pa.Table:
        entries = [X.thaw(p.as_py()) for p in table.column("payload")]
        key, count = np.concatenate([e["key"] for e in entries]), np.concatenate([e["count"] for e in entries]).astype(np.int64)
        order, start, _ = X.groups(key)
        sums = np.add.reduceat(count[order], start)
        often = sums >= OFTEN
        return pa.table({"name": pa.array(np.append(key[order][start][often], np.uint64(0)).astype(np.int64)), "n": pa.array(np.append(sums[often], -len(start))), "all": pa.array(np.append(sums[often] * 0, sums.sum()))})

    counted = X.keyed(docs).mapInArrow(read, X.SCHEMA).groupBy("bucket").applyInArrow(total, "name long, n long, all long")
    counted = written(counted, "frequent")
    sizes = counted.where("n <= 0").agg(F.sum("all"), -F.sum("n")).first()
    top = counted.where("n > 0").orderBy(F.desc("n"), "name").limit(FREQUENT).select("name", "n").toPandas()  # FREQUENT rows at most
    discard(counted)
    names = top["name"].to_numpy().astype(np.int64).astype(np.uint64)
    place = np.argsort(np.lexsort((names, top["n"].to_numpy()))).astype(np.uint64)
    order = np.argsort(names)
    return np.stack([names[order], place[order]]), (sizes[0] or 0) / max(1, sizes[1] or 1)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def lists(docs: DataFrame, frequent: np.ndarray, most: int, bits: int) -> DataFrame:
    """(name, place, n, doc) of every list with two members or more, and one row without name for each document.

    The document's row holds its bitmap and digest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    needs_list = -(-NUM * (most + 1) // DEN)  # light sets from here on may be similar to a heavy one

    def read(batches):
        top = shared.value
        for chunk, keys, prints, body, at in X.read_chunks(batches):
            names, place, size, owner = [], [], [], []
            sets = shingle_sets(body, at)
            for d, s in enumerate(sets):
                n = len(s)
                parts = [(subsets(s, most), False)] if 0 < n <= most else []
                if n >= needs_list and n:
                    parts.append((_rank(s, top)[: prefix(n)], True))
                for found, ordered in parts:
                    names.append(found)
                    place.append(np.arange(len(found), dtype=np.int32) if ordered else np.full(len(found), -1, np.int32))
                    size.append(np.full(len(found), n, np.int32))
                    owner.append(np.full(len(found), keys[d]))
            # The documents themselves ride along as own rows.
            bitmaps = [parity(s) for s in sets]
            digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            own = {"doc": keys, "n": np.array([len(s) for s in sets], np.int64), "bytes": np.array([len(b) for b in bitmaps], np.int64)}
            own |= {"bitmap": np.frombuffer(b"".join(bitmaps), np.uint8), "digest": np.frombuffer(digests, np.uint8)}
            yield X.build_rows([X.own_row(chunk, bits, **own)])
            if not names:
                continue
            names, place, size, owner = (np.concatenate(x) for x in (names, place, size, owner))
            fine = np.flatnonzero(owner != X.LAST)
            # Frequent names are known to have lists: they don't crowd buckets but are dealt by document.
            spot = np.searchsorted(top[0], names[fine]) if top.shape[1] else np.zeros(len(fine), np.int64)
            spot[spot == top.shape[1]] = 0
            often = top[0][spot] == names[fine] if top.shape[1] else np.zeros(len(fine), bool)
            hot, rare = fine[often], fine[~often]
            yield X.build_rows(list(X.to_buckets(chunk, names[rare], bits, {"doc": owner[rare]}, place=_narrow(place[rare] + 1), size=_narrow(size[rare]), **X.short_names(names[rare], bits))))
            yield X.build_rows(list(X.to_buckets(chunk, mix(owner[hot].astype(np.uint64)), bits, {"doc": owner[hot]}, name=names[hot], place=_narrow(place[hot] + 1), size=_narrow(size[hot]))))

    def join(table: pa.Table) -> pa.Table:
        out, entries, bitmaps, digests = [], [], [], []
        none = lambda n: [pa.nulls(n, pa.binary())]
        for p in table.column("payload"):
            e = X.thaw(p.as_py())
            if "top" in e:
                entries.append(e)
            elif "name" in e:
                out.append((e["name"], e["place"], e["size"], X.from_planes(e, "doc")))
                bitmaps += none(len(e["place"]))
                digests += none(len(e["place"]))
            else:
                out.append((None, np.zeros(len(e["doc"]), np.uint16), e["n"], e["doc"]))
                at, marks, prints = np.append(0, np.cumsum(e["bytes"])).tolist(), e["bitmap"].tobytes(), e["digest"].tobytes()
                bitmaps.append(pa.array([marks[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary()))
                digests.append(pa.array([prints[k : k + 16] for k in range(0, len(prints), 16)], pa.binary()))
        if entries:
            name = X.from_short(entries)
            multi = np.flatnonzero(X.shared_names(name))
            place, size = (np.concatenate([e[c] for e in entries])[multi] for c in ("place", "size"))
            out.append((name[multi] | np.uint64(table.column("bucket")[0].as_py() << 40), place, size, np.concatenate([X.from_planes(e, "doc") for e in entries])[multi]))
            bitmaps += none(len(multi))
            digests += none(len(multi))
        names = [pa.nulls(len(o[3]), pa.int64()) if o[0] is None else pa.array(o[0].astype(np.int64)) for o in out]
        place, size, doc = (np.concatenate([o[k].astype(np.int64) for o in out]) for k in (1, 2, 3))
        marks = {c: pa.chunked_array(x, pa.binary()) for c, x in (("bitmap", bitmaps), ("digest", digests))}
        return pa.table({"name": pa.chunked_array(names, pa.int64()), "place": (place - 1).astype(np.int32), "n": size, "doc": doc} | marks)

    return X.keyed(docs).mapInArrow(read, X.SCHEMA).groupBy("bucket").applyInArrow(join, "name long, place int, n long, doc long, bitmap binary, digest binary")


def united(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows, where a doc_id that has different texts is one row of all, and (doc, rows) of these ids if any."""
    known = X.keyed(docs).where(F.col("_key") != X.LAST).groupBy("_key").agg(F.min("_print").alias("low"), F.max("_print").alias("high"), F.count("*").alias("rows"))
    mixed = written(known.where("low < high").select(F.col("_key").alias("doc_id"), "rows"), "mixed")
    if mixed.isEmpty():
        return docs, None
    texts = docs.join(mixed, "doc_id", "left_semi").where("text IS NOT NULL").distinct().groupBy("doc_id")
    one = texts.agg(F.expr(f"array_join(collect_list(text), cast(X'{BREAK:02X}' AS string))").alias("text"))
    return docs.join(mixed, "doc_id", "left_anti").unionByName(one), mixed.withColumnRenamed("doc_id", "doc")


def copies_of(marks: DataFrame) -> DataFrame:
    """(doc, first, share) of the documents whose set an earlier one has; what meets in a set is dealt to shares."""
    dealt = marks.select("doc", "digest", F.pmod(F.xxhash64("doc"), F.lit(SHARES)).cast("int").alias("share"))
    parts = dealt.groupBy("digest", "share").agg(F.min("doc").alias("low"), F.count("*").alias("m"))
    first = parts.groupBy("digest").agg(F.min("low").alias("first"), F.sum("m").alias("m")).where("m > 1").select("digest", "first")
    return dealt.join(parts.join(first, "digest").select("digest", "share", "first"), ["digest", "share"]).where("doc <> first").select("doc", "first", "share")


def sifted(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link by their bitmaps.  A document in very many pairs is dealt to shares."""
    for side, other in ("ab", "ba"):
        pairs = pairs.withColumn("share", F.pmod(F.xxhash64(other), F.lit(SHARES)).cast("int"))
        spread = pairs.select(side, "share").distinct()
        held = spread.join(marks.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bitmap_{side}")), side)
        pairs = pairs.join(held, [side, "share"]).drop("share")

    def sift(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b"))
            yield _links([(a, b) for a, b, n, m, x, y in zip(*columns) if may_link(np.frombuffer(x, np.uint64), n, np.frombuffer(y, np.uint64), m)])

    return written(pairs.mapInArrow(sift, "a long, b long"), "sifted")


def _bound(place_a, n_a, place_b, n_b):
    """Whether two sets that share a name at these places can still share enough: one and all behind it at most."""
    most = F.lit(1) + F.least(n_a - place_a - 1, n_b - place_b - 1)
    enough = (NUM + DEN) * most >= NUM * (n_a + n_b)
    fits = (DEN * F.least(n_a, n_b) >= NUM * F.greatest(n_a, n_b))
    return fits & ((place_a < 0) | enough)


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, names) of the documents with the ids (_key); packed names.  Repeated rows give a row each."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                found = shingle_sets(*raw_bytes(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array([s.tobytes() for s in found], pa.binary())], ["doc", "names"])

    texts = X.keyed(docs).join(ids.distinct(), "_key", "left_semi").select("_key", "_text")
    return written(texts.mapInArrow(run, "doc long, names binary"), "sets")


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; their sets are compared in full."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("_key")), docs)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = dealt.join(sets.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", "names")
    centres = parts.join(sets.withColumnRenamed("doc", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "names")

    def compare(batches):
        centre, own, last, merged = None, None, None, None

        def linked():
            both = len(np.intersect1d(own, merged, True))
            return both > 0 and DEN * both >= NUM * (len(own) + len(merged) - both)

        for batch in batches:
            out = []
            for a, part, b, names in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "names"))):
                x = np.frombuffer(names, np.uint64)
                if last is not None and (a, part, b) != (*centre, last):
                    if linked():
                        out.append((centre[0], last))
                    last = None
                if (a, part) != centre:
                    centre, own = (a, part), x
                elif b is None:
                    own = np.union1d(own, x)
                elif b == last:
                    merged = np.union1d(merged, x)
                else:
                    last, merged = b, x
            yield _links(out)
        if last is not None and linked():
            yield _links([(centre[0], last)])

    ordered = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = written(ordered.mapInArrow(compare, "a long, b long"), "verified")
    discard(sets)
    free_shuffles()
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many names each set of a shares with each of b: products of 0/1 matrices, some names at a time."""
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), True)
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(both), COLUMNS):
        columns = both[start : start + COLUMNS]

        def matrix(sets):
            m = np.zeros((len(sets), len(columns)), np.float32)
            for row, s in enumerate(sets):
                spot = np.searchsorted(columns, s)
                spot[spot == len(columns)] = 0
                m[row, spot[columns[spot] == s]] = 1
            return m

        out += matrix(a) @ matrix(b).T
    return out


def _near_rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if n in ("i", "j", "own") else pa.int64()) for k, n in enumerate(names)], names)


def block_links(members: DataFrame, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Links (a, b) that join different components among the members (centre, doc, component) of each centre.

    A component with a block of members or more has blocks of its own, which never meet each other: most members of a
    large group lie in one component already, and only those outside are compared with them.  Blocks meet by bitmaps
    first; sets are sent for members that may have a link there.
    """
    count = lambda c: F.ceil(c / STAR).cast("int")
    sizes = members.groupBy("centre", "component").agg(F.count("*").alias("m"))
    large = F.when(F.col("m") >= STAR, F.struct("component", count(F.col("m")).alias("blocks")))
    plan = sizes.groupBy("centre").agg(count(F.sum(F.when(F.col("m") < STAR, F.col("m")).otherwise(0))).alias("mixed"), F.array_sort(F.collect_list(large)).alias("large"))
    before = lambda i: F.aggregate(F.slice("large", 1, i), F.col("mixed"), lambda n, x: n + x["blocks"])
    spans = F.transform("large", lambda x, i: F.struct(x["component"].alias("component"), before(i).alias("start"), (before(i) + x["blocks"]).alias("end")))
    plan = plan.select("centre", "mixed", spans.alias("spans"))
    plan = written(plan.withColumn("blocks", F.coalesce(F.get("spans", F.size("spans") - 1)["end"], F.col("mixed"))), "plan")
    dealt = members.join(plan, "centre").withColumn("span", F.filter("spans", lambda x: x["component"] == F.col("component")))
    dealt = dealt.withColumn("span", F.get("span", F.lit(0))).drop("spans")
    turn = F.xxhash64("doc")
    own = F.when(F.col("span").isNotNull(), F.col("span.start") + F.pmod(turn, F.col("span.end") - F.col("span.start"))).otherwise(F.pmod(turn, F.greatest("mixed", F.lit(1))))
    dealt = dealt.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.where(~F.coalesce((F.col("other") >= F.col("span.start")) & (F.col("other") < F.col("span.end")), F.lit(False)))
    dealt = dealt.select("centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "component")
    met = lambda table: table.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "doc")

    def sift(batches):
        def near(held):
            """Members that may link with one of the other block and of another component, by classes of bitmap size."""
            i, j = held[0][1:3]
            doc, component, size = (np.array([h[k] for h in held]) for k in (4, 5, 6))
            own, words = np.array([h[3] for h in held]), np.array([len(h[7]) // 8 for h in held])
            found = np.zeros(len(held), bool)
            for w in np.unique(words).tolist():
                left = np.flatnonzero((own == i) & (words == w))
                for v in (w // 2, w, 2 * w):
                    right = np.flatnonzero((own == j) & (words == v))
                    if not len(left) or not len(right):
                        continue
                    y = folded(np.stack([np.frombuffer(held[k][7], np.uint64) for k in right]), w)
                    for k in left.tolist():
                        hit = may_link(np.frombuffer(held[k][7], np.uint64), size[k], y, size[right])
                        hit &= (component[right] != component[k]) & (doc[right] != doc[k])
                        found[right[hit]] = True
                        found[k] |= hit.any()
            return [held[k][:6] for k in np.flatnonzero(found).tolist()]

        names, held = ["centre", "i", "j", "own", "doc", "component"], []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "n", "bitmap"))):
                if held and row[:3] != held[0][:3]:
                    out += near(held)
                    held = []
                held.append(row)
            yield _near_rows(out, names)
        if held:
            yield _near_rows(near(held), names)

    near = met(dealt.join(marks.select("doc", "n", "bitmap"), "doc")).mapInArrow(sift, "centre long, i int, j int, own int, doc long, component long")
    near = written(near, "near")
    sets = sets_of(near.select(F.col("doc").alias("_key")), docs)
    rows = met(near.join(sets, "doc"))

    def compare(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        def links(i, j, held):
            docs = list(held)
            side = [[d for d in docs if held[d][0] == k] for k in (i, j)]
            if not side[0] or not side[1]:
                return
            a, b = ([held[d][2] for d in s] for s in side)
            both = _overlaps(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None] - both
            for x, y in zip(*np.nonzero((both > 0) & (DEN * both >= NUM * union))):
                p, q = side[0][x], side[1][y]
                rp, rq = root(held[p][1]), root(held[q][1])
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    yield p, q

        group, held = None, {}
        for batch in batches:
            out = []
            for *key, own, doc, component, names in zip(*(batch.column(c).to_pylist() for c in ("centre", "i", "j", "own", "doc", "component", "names"))):
                if key != group:
                    if held:
                        out += links(*group[1:], held)
                    group, held = key, {}
                x = np.frombuffer(names, np.uint64)
                held[doc] = own, component, np.union1d(held[doc][2], x) if doc in held else x
            yield _links(out)
        if held:
            yield _links(list(links(*group[1:], held)))

    out = written(rows.mapInArrow(compare, "a long, b long"), "block-links")
    discard(sets)
    free_shuffles()
    return out


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    bits = X.bucket_bits(spark)
    rows, mixed = united(rows)
    frequent, list_length = frequent_names(rows, bits)
    free_shuffles()
    found = written(lists(rows, frequent, boundary(list_length), bits), "lists")
    free_shuffles()
    listed = found.where(F.col("name").isNotNull()).drop("bitmap", "digest")
    marks = found.where(F.col("name").isNull() & (F.col("doc") != X.LAST) & (F.col("n") > 0)).select("doc", "n", "bitmap", "digest")
    marks = written(marks.dropDuplicates(["doc"]), "marks")
    copies = written(copies_of(marks), "copies")

    # First every member of a list with the document of which most names are shared.
    shared = listed.groupBy("doc").agg((F.count("*") / F.greatest(F.first("n"), F.lit(1))).alias("shared")).join(copies, "doc", "left_anti")
    ranked = listed.join(shared, "doc")
    centre = F.max(F.struct("shared", -F.col("doc"), "doc", "place", "n")).alias("centre")
    members = ranked.drop("shared").join(ranked.groupBy("name").agg(centre), "name")
    c = lambda x: F.col("centre").getField(x)
    members = members.select("name", "doc", "place", "n", c("doc").alias("c_doc"), c("place").alias("c_place"), c("n").alias("c_n"))
    members = written(members, "members")
    free_shuffles()
    low, high = F.least("c_doc", "doc").alias("a"), F.greatest("c_doc", "doc").alias("b")
    star = members.where((F.col("c_doc") != F.col("doc")) & _bound(F.col("c_place"), F.col("c_n"), F.col("place"), F.col("n"))).select(low, high).distinct()
    star = written(star, "star")
    links = verified(sifted(star, marks), rows)
    comps = written(components(links), "components")

    # Then, in lists that still lie in several components, members of different ones.
    owned = members.join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    split = owned.groupBy("name").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("name")
    before = F.when(F.col("place") >= 0, F.lag("name").over(Window.partitionBy("doc").orderBy("place", "name")))
    rest = owned.join(split, "name").select("name", "doc", "place", "n", "component", F.col("c_doc").alias("centre"), before.alias("before"))
    rest = written(rest, "rest")
    free_shuffles()
    around = rest.groupBy("centre", "doc").agg(F.first("component").alias("component"))
    many = around.groupBy("centre").agg(F.count("*").alias("m")).where(F.col("m") > MANY).select("centre")
    more = block_links(written(around.join(many, "centre"), "around"), rows, marks)

    few = rest.join(many, "centre", "left_anti")
    left, right = (few.select("name", *(F.col(x).alias(f"{x}_{s}") for x in ("doc", "place", "n", "component", "before"))) for s in "ab")
    met = F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False))
    across = left.join(right, "name").where((F.col("component_a") < F.col("component_b")) & ~met & _bound(F.col("place_a"), F.col("n_a"), F.col("place_b"), F.col("n_b")))
    across = across.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()
    across = written(across.join(star, ["a", "b"], "left_anti"), "across")
    free_shuffles()
    more = more.unionAll(verified(sifted(across, marks), rows))
    for table in (members, rest):
        discard(table)
    comps = written(extended(comps, more), "components")

    # Copies have the component of the first of their set.
    firsts = copies.select("first", "share").distinct().join(comps.withColumnRenamed("node", "first"), "first", "left")
    firsts = firsts.select("first", "share", F.coalesce("component", "first").alias("component"))
    comps = comps.unionByName(copies.join(firsts, ["first", "share"]).select(F.col("doc").alias("node"), "component"))

    documents = found.where(F.col("name").isNull())
    if mixed is not None:
        documents = documents.join(mixed, "doc", "left").withColumn("row", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)))))
    documents = documents.select(F.nullif("doc", F.lit(X.LAST)).alias("doc_id"), F.col("n").alias("n_shingles"))
    return documents.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * k >= 75 * (u.n + v.n - k)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN r ON r.a = t.doc_id GROUP BY ALL
"""
