"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

A pair with Jaccard similarity of at least t shares at least t of the n-grams of either side. That bounds, by the
sizes alone, which rows and which pairs can matter:

1. Document frequencies of all n-grams. A document with fewer than t of its n-grams in a second document is a
   class of its own; most documents end here and only fingerprints of n-grams were moved.
2. Documents with equal sets are one row of the matrix.
3. Two rows that reach the bound share one of their rarest ``n - ceil(t n) + 1`` n-grams (prefix). Rows connected
   by such n-grams form a family: every link lies within a family.
4. Each family's product is computed blockwise: a row times the postings of the rows not yet reached gives their
   overlap counts; pairs below the bound are dropped, rows above it join the class. A family above
   ``TILE_ROWS`` is dealt out in tiles: tiles on their own and against a few common pivots first, then
   what is not in the largest class against all tiles. No pair is left out unless both rows are in one
   class already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abridge.llm import blocks as B
from abridge.llm.common import Scratch, lower_ascii
from abridge.llm.components import connected_components

TILE_ROWS = 1500
PIVOTS = 16
BIN_GRAMS = 1_000_000   # n-grams of the families that one task handles


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the documents) of UTF-8 texts."""
    import xxhash
    lists = pc.ascii_split_whitespace(text.cast(pa.large_string()))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(real)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    d = flat.dictionary_encode()
    names = d.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    return table[d.indices.to_numpy()[real]], off.astype(np.int64)


def shingle_sets(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles, by document and hash, and the set sizes.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    h = np.zeros(len(words), np.uint64)
    place = np.arange(len(words)) - off[doc]
    count = np.minimum(size, k)[doc]
    for j in range(k):
        at = np.minimum(np.arange(len(words)) + j, max(0, len(words) - 1))
        h = np.where(j < count, B.mix64(h + words[at] + np.uint64(j + 1)), h)
    first = place <= np.maximum(size - k, 0)[doc]
    h = B.mix64(h + count.astype(np.uint64))[first]
    doc = doc[first]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return doc, h, np.bincount(doc, minlength=n)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least number of shared n-grams for a set of n."""
    return -(-percent * n // 100)


def linked(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def grow_classes(sets: list[np.ndarray], sizes: np.ndarray, percent: int, label: np.ndarray) -> np.ndarray:
    """Join the labels of linked rows. Rows are visited from their class on; reached rows leave the matrix."""
    n = len(sets)
    label = label.copy()
    grams, col = np.unique(np.concatenate(sets), return_inverse=True)
    lens = np.array([len(s) for s in sets])
    row_at = np.concatenate([[0], np.cumsum(lens)])
    waiting = np.ones(n, bool)

    def postings():
        keep = np.repeat(waiting, lens)
        rows = np.repeat(np.arange(n), lens)[keep]
        cols = col[keep]
        order = np.argsort(cols, kind="stable")
        return rows[order], np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=len(grams)))])

    members: dict[int, list[int]] = {}
    for i, x in enumerate(label):
        members.setdefault(int(x), []).append(i)
    post, start = postings()
    indexed = n
    for seed in range(n):
        if not waiting[seed]:
            continue
        front = list(members[int(label[seed])])
        waiting[front] = False
        while front:
            if waiting.sum() < indexed // 2:
                post, start = postings()
                indexed = int(waiting.sum())
            if not indexed:
                front = []
                break
            x = front.pop()
            c = col[row_at[x]:row_at[x + 1]]
            a, m = start[c], start[c + 1] - start[c]
            take = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            overlap = np.bincount(post[take], minlength=n)
            hit = np.flatnonzero(waiting & (overlap > 0))
            hit = hit[linked(overlap[hit], sizes[x], sizes[hit], percent)]
            if len(hit):
                mine = int(label[seed])
                for other in np.unique(label[hit]):
                    group = members.pop(int(other))
                    fresh = [g for g in group if waiting[g]]
                    waiting[fresh] = False
                    front += fresh
                    label[group] = mine
                    members[mine] += group
    return label


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents linked directly or through others.

    Texts are lower-cased (A-Z) and cut into words at ASCII spaces; a document's set are its distinct ``k``-word
    shingles. Two documents link if 100 * intersection >= percent * union. component_id is the smallest id in
    the class. Null, empty and blank texts have an empty set and a class of their own. Ids are long and not null; of
    repeated ids each row is a document, and their classes are joined. Other columns are not used. An empty
    table gives an empty one. Shingles are compared by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")

    def encode(batch: pa.RecordBatch) -> dict[str, object]:
        words, off = word_hashes(batch.column(1).cast(pa.string()))
        vocabulary, index = np.unique(words, return_inverse=True)
        return {"ids": B.squeeze(batch.column(0).to_numpy()), "vocabulary": B.squeeze_sorted(vocabulary),
                "words": B.squeeze(index.astype(np.uint32)), "sizes": B.squeeze(np.diff(off))}

    def read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = B.expand_sorted(row.vocabulary)[B.expand(row.words, np.uint32)]
        off = np.concatenate([[0], np.cumsum(B.expand(row.sizes, np.int64))])
        return B.expand(row.ids, np.int64), *shingle_sets(words, off, k)

    table = B.text_blocks(docs.select(B.id_or_least(id_col), lower_ascii(text_col).cast("binary")), scratch,
                          {"ids": "binary", "vocabulary": "binary", "words": "binary", "sizes": "binary"}, encode)
    shards = B.shard_count(table)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                keys, count = np.unique(read(row)[2], return_counts=True)
                yield pd.DataFrame([(s, row.block, B.squeeze_sorted(keys[x]), B.squeeze(count[x].astype(np.uint32)))
                                    for s, x in B.shard_slices(keys, shards)],
                                   columns=["shard", "block", "keys", "counts"])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        keys = [B.expand_sorted(x) for x in g["keys"]]
        where = np.unique(np.concatenate(keys), return_inverse=True)[1]
        count = np.concatenate([B.expand(x, np.uint32) for x in g["counts"]])
        total = np.bincount(where, weights=count).astype(np.uint32)[where]
        cut = np.cumsum([len(x) for x in keys])[:-1]
        return pd.DataFrame({"block": g["block"], "shard": g["shard"],
                             "frequency": [B.squeeze(x) for x in np.split(total, cut)]})

    # A row a document: what is alone is only counted; the others carry their set and its prefix.
    def finish(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = []
        freq = np.concatenate([B.expand(x, np.uint32) for x in a.sort_values("shard")["frequency"]] or
                              [np.zeros(0, np.uint32)])
        for row in b.itertuples():
            ids, doc, h, n = read(row)
            keys, index = np.unique(h, return_inverse=True)
            f = freq[index]
            shared = np.bincount(doc[f >= 2], minlength=len(ids))
            live = (n > 0) & (shared >= needed(n, percent))
            at = np.concatenate([[0], np.cumsum(n)])
            for i in range(len(ids)):
                if not live[i]:
                    out.append((ids[i], n[i], None, None, None))
                    continue
                x, fx = h[at[i]:at[i + 1]], f[at[i]:at[i + 1]]
                rare = np.lexsort((x, fx))[:n[i] - needed(n[i], percent) + 1]
                rare = rare[fx[rare] >= 2]
                out.append((ids[i], n[i], hashlib.blake2b(x.tobytes(), digest_size=16).digest(),
                            B.squeeze_sorted(x[fx >= 2]), x[rare].view(np.int64)))
        return pd.DataFrame(out, columns=["doc_id", "n", "signature", "grams", "prefix"])

    questions = table.mapInPandas(ask, "shard long, block string, keys binary, counts binary")
    answers = B.by_shard(questions, answer, "block string, shard long, frequency binary")
    rows = scratch.store(B.with_answers(table, answers, finish, "doc_id long, n long, signature binary, "
                                        "grams binary, prefix array<long>"), "rows")
    alike = rows.where("signature is not null").groupBy("signature").agg(F.min("doc_id").alias("rep"),
                                                                         F.count(F.lit(1)).alias("copies"))
    alike = scratch.store(alike, "alike")
    reps = alike.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    heads = rows.where("signature is not null").join(alike.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    links = _family_links(heads.withColumnRenamed("doc_id", "rep").drop("signature"), scratch, percent)
    # Rows with the set of their representative are linked with it.
    copies = rows.select("doc_id", "signature").join(alike.where("copies > 1"), "signature").where("doc_id <> rep")
    edges = links.unionByName(reps).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    classes = connected_components(edges, scratch, "classes")
    done = rows.select("doc_id", F.col("n").alias("n_shingles")).join(classes, F.col("doc_id") == F.col("node"), "left")
    done = done.select(B.least_as_null(F.col("doc_id")).alias("doc_id"), "n_shingles",
                       B.least_as_null(F.coalesce("component", "doc_id")).alias("component_id"))
    result = Scratch(spark, "jaccard-result").store(done, "classes")
    scratch.drop()
    return result


def _family_links(reps: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) between representatives that span the classes; reps: (rep, n, grams, prefix).

    The sets are dealt out twice: to the family of their row, and with it to a task.
    """
    spark = reps.sparkSession
    post = reps.select("rep", F.explode("prefix").alias("gram"))
    low = post.groupBy("gram").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    stars = post.join(low, "gram").where("rep <> b").select(F.col("rep").alias("a"), "b")
    family = scratch.store(connected_components(stars, scratch, "families"), "families")
    size = family.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    rows = (family.join(size, "component").withColumnRenamed("component", "family")
            .join(reps.select("rep", "n", "grams"), F.col("node") == F.col("rep")).drop("node"))
    rows = scratch.store(rows, "members")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, -(-total // BIN_GRAMS))
    found = "a long, b long"

    def classes(g: pd.DataFrame, label: np.ndarray) -> pd.DataFrame:
        """Links from each row to the row that its class is called after."""
        sets = [B.expand_sorted(x) for x in g["grams"]]
        out = grow_classes(sets, g["n"].to_numpy(), percent, label)
        ids = g["rep"].to_numpy()
        same = out == label
        return pd.DataFrame({"a": ids[~same], "b": ids[out[~same]]})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        parts = [classes(f.reset_index(drop=True), np.arange(len(f))) for _, f in g.groupby("family")]
        return pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": []})

    small = rows.where(F.col("rows") <= TILE_ROWS).withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins)))
    links = scratch.store(small.groupBy("bin").applyInPandas(whole, found), "small")
    large = rows.where(F.col("rows") > TILE_ROWS)
    if large.isEmpty():
        return links
    large = large.withColumns({"tiles": F.ceil(F.col("rows") / TILE_ROWS), "_h": F.xxhash64(F.lit("tile"), "rep")})
    large = large.withColumn("tile", F.pmod(F.col("_h"), F.col("tiles")))
    first = (large.withColumn("_k", F.row_number().over(Window.partitionBy("family", "tile").orderBy("_h")))
             .where(F.col("_k") <= PIVOTS).withColumn("_k", F.row_number().over(Window.partitionBy("family").orderBy("_h")))
             .where(F.col("_k") <= PIVOTS).drop("_k"))
    copies = first.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiles = (large.withColumn("to", F.col("tile")).unionByName(copies.where("to <> tile")).groupBy("family", "to"))
    links = links.unionByName(scratch.store(
        tiles.applyInPandas(lambda g: classes(g, np.arange(len(g))), found), "tiles"))
    every = large.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    label = scratch.store(connected_components(links.unionByName(every), scratch, "tiled"), "labels")
    large = large.join(label, F.col("rep") == F.col("node")).drop("node")
    # What the largest class of a family has not taken meets all tiles.
    top = (large.groupBy("family", "component").count().groupBy("family")
           .agg(F.max_by("component", F.struct("count", "component")).alias("top"), F.sum("count").alias("_n")))
    large = scratch.store(large.join(top.drop("_n"), "family"), "large")
    rest = large.where("component <> top")
    if rest.isEmpty():
        return links
    count = rest.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("rests"))
    part = rest.join(count, "family").withColumn("rest", F.pmod(F.xxhash64(F.lit("rest"), "rep"), F.col("rests")))
    part = part.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("is", F.lit(1))
    against = (large.join(count, "family").withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)))
               .withColumns({"to": F.col("tile"), "is": F.lit(0)}))

    def cross(g: pd.DataFrame) -> pd.DataFrame:
        """Rows of one class start as one; a row may be here as rest and as member of the tile."""
        g = g.sort_values("is", ascending=False).drop_duplicates("rep").reset_index(drop=True)
        head = g.groupby("component")["rep"].transform("idxmin").to_numpy()
        return classes(g, head)

    cols = ["family", "to", "rest", "rep", "n", "grams", "component", "is"]
    crossed = part.select(cols).unionByName(against.select(cols)).groupBy("family", "to", "rest")
    return links.unionByName(scratch.store(crossed.applyInPandas(cross, found), "cross"))
