"""Partition algebra, identities and the ordered edit ledger."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterspark.functions.scalar import first_reason, reasons
from rasterspark.operators import graph
from rasterspark.operators.local import FIELD
from rasterspark.session import cut_lineage

AT = ["field_id", "y", "x"]
CELL = ["field_id", "cell_id"]


# ----------------------------------------------------------------- partitions


#: Pixels in a partition where pixel tables meet.
MEET_PIXELS = 500_000


def _meeting(*tables: DataFrame) -> int:
    """Partitions in which pixel tables meet, by their rows.

    The planner doesn't count exploded rows and would broadcast millions of pixels; and it joins
    partitions by their bytes, and pixel rows compress so well that a task would hold millions.
    """
    rows = reduce(DataFrame.union, [t.select(F.lit(1)) for t in tables])
    return rows.count() // MEET_PIXELS + 1


def partition_compartments(whole: DataFrame, soma: DataFrame) -> DataFrame:
    """Processes = whole without soma, as one table with a ``part`` column.

    Inputs: (field_id, y, x, cell_id). Soma pixels outside their own whole cell
    are left out here and reported by :func:`check_partition`.
    """
    k = [*AT, "cell_id"]
    n = _meeting(whole, soma)
    inner = soma.select(*k).repartition(n, *k).distinct().withColumn("_in", F.lit(True))
    inner = inner.hint("merge") if n > 1 else inner
    return whole.select(*k).repartition(n, *k).join(inner, k, "left").select(*k, F.when(F.col("_in"), "soma").otherwise("processes").alias("part"))


def check_partition(whole: DataFrame, soma: DataFrame, processes: DataFrame) -> DataFrame:
    """Violations of whole = soma + processes per cell."""
    k = [*AT, "cell_id"]
    n = _meeting(whole, soma, processes)
    flag = lambda df, c: df.select(*k, F.lit(True).alias(c)).repartition(n, *k)
    j = flag(whole, "w").join(flag(soma, "s"), k, "full_outer").repartition(n, *k).join(flag(processes, "p"), k, "full_outer")
    has = lambda c: F.col(c).isNotNull()
    rule = first_reason(
        ("soma_outside_whole", has("s") & ~has("w")), ("processes_outside_whole", has("p") & ~has("w")),
        ("overlap", has("s") & has("p")), ("not_covered", has("w") & ~has("s") & ~has("p")))
    return j.withColumn("violation", rule).where(F.col("violation").isNotNull()).groupBy("field_id", "cell_id", "violation").agg(F.count(F.lit(1)).alias("pixels"))


def check_triplet(layers: DataFrame, identities: DataFrame) -> DataFrame:
    """Violations of a label triplet: ids contiguous and equal in all layers, unique identities.

    ``layers``: (field_id, layer, y, x, label_id); ``identities``: (field_id,
    label_id, original_id, cell_uid).
    """
    ids = layers.select("field_id", "layer", "label_id").distinct()
    g = ids.groupBy("field_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.min("label_id").alias("lo"), F.max("label_id").alias("hi"))
    gaps = g.where((F.col("lo") != 1) | (F.col("hi") != F.col("n"))).select("field_id", F.concat(F.lit("ids_not_contiguous_"), F.col("layer")).alias("violation"))
    k = ids.groupBy("field_id", "label_id").agg(F.countDistinct("layer").alias("k")).where(F.col("k") != 3)
    differ = k.select("field_id", F.lit("layer_ids_differ").alias("violation")).distinct()
    u = identities.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_uid").alias("u"), F.countDistinct("original_id").alias("o"))
    dup = u.select("field_id", F.explode(F.array_compact(F.array(
        F.when(F.col("u") != F.col("n"), "cell_uid_not_unique"), F.when(F.col("o") != F.col("n"), "original_id_not_unique")))).alias("violation"))
    return gaps.unionByName(differ).unionByName(dup)


def check_edit_delta(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """Violations of one edit per field: enlarge keeps ids, split adds one, others stay untouched.

    ``before``/``after``: (field_id, y, x, cell_id, part); ``edits``: (field_id,
    operation, cell_id).
    """
    k = [*AT, "cell_id", "part"]
    ids = lambda df, n: df.groupBy("field_id").agg(F.countDistinct("cell_id").alias(n))
    c = edits.join(ids(before, "n0"), "field_id").join(ids(after, "n1"), "field_id")
    want = F.when(F.col("operation") == "split", F.col("n0") + 1).otherwise(F.col("n0"))
    count = c.where(F.col("n1") != want).select("field_id", F.lit("cell_count").alias("violation"))
    target = edits.select("field_id", F.col("cell_id").alias("_t"))
    old = before.select("field_id", "cell_id").distinct().join(target, "field_id").where(F.col("cell_id") != F.col("_t")).select("field_id", "cell_id")
    other = lambda df: df.select(*k).join(old, CELL, "left_semi")
    a, b = other(before), other(after)
    moved = a.exceptAll(b).unionByName(b.exceptAll(a)).select("field_id").distinct().withColumn("violation", F.lit("other_cell_changed"))
    grown = edits.where(F.col("operation") == "enlarge").select("field_id", F.col("cell_id"))
    whole = lambda df: df.join(grown, CELL, "left_semi").select(*AT, "cell_id")
    w = whole(before).exceptAll(whole(after)).select("field_id").distinct().withColumn("violation", F.lit("enlarge_lost_pixels"))
    return count.unionByName(moved).unionByName(w)


# --------------------------------------------------------------- set-like edits


def edit_delete(regions: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove cells from all compartments; a field may not lose its last cell.

    ``deletes``: (field_id, cell_id). Returns (regions, audit).
    """
    cells = regions.select(*CELL).distinct()
    hit = cells.join(deletes.select(*CELL).distinct(), CELL, "left_semi").withColumn("_d", F.lit(1))
    n = cells.join(hit, CELL, "left").groupBy("field_id").agg(F.count(F.lit(1)).alias("cells"), F.count("_d").alias("requested"))
    audit = n.where(F.col("requested") > 0).withColumn("status", F.when(F.col("requested") < F.col("cells"), "applied").otherwise("last_cell_kept"))
    ok = audit.where(F.col("status") == "applied").select("field_id")
    gone = hit.drop("_d").join(ok, "field_id", "left_semi")
    return regions.join(gone, CELL, "left_anti"), audit


def edit_merge(regions: DataFrame, merges: DataFrame, pixel_um: tuple[float, float], max_gap_um: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Unite cells whose somas form one graph with gaps up to ``max_gap_um``.

    ``merges``: (field_id, merge_id, cell_id). Somas are compared run by run: two runs of
    pixels are as near as their nearest ends. The result takes the lowest cell id.
    """
    k = ["field_id", "merge_id"]
    merges = cut_lineage(merges)
    order = Window.partitionBy(*CELL, "y").orderBy("x")
    soma = regions.where(F.col("part") == "soma").select(*AT, "cell_id").join(merges.select(*CELL).distinct(), CELL, "left_semi").distinct()
    runs = soma.withColumn("_g", F.col("x") - F.row_number().over(order)).groupBy(*CELL, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = cut_lineage(runs.drop("_g").join(merges, CELL))
    (dy_um, dx_um), limit = pixel_um, max_gap_um * max_gap_um * (1 + 1e-12)
    reach = max(1, int(max_gap_um / dy_um + 1e-9))
    left = runs.select(*k, F.col("cell_id").alias("a"), F.col("x0").alias("_a0"), F.col("x1").alias("_a1"), "y", F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1)])).alias("_dy"))
    right = runs.select(*k, F.col("cell_id").alias("b"), "y", "x0", "x1")
    gap = F.greatest(F.lit(0), F.col("x0") - F.col("_a1"), F.col("_a0") - F.col("x1")) * dx_um
    near = F.col("_dy") * dy_um * (F.col("_dy") * dy_um) + gap * gap <= limit
    pairs = left.withColumn("y", F.col("y") + F.col("_dy")).join(right, [*k, "y"]).where((F.col("a") < F.col("b")) & near).select(*k, "a", "b").distinct()
    root = graph.label_closure(pairs, k).select(*k, F.col("node").alias("cell_id"), "root")
    g = merges.join(root, [*k, "cell_id"], "left").withColumn("root", F.coalesce("root", "cell_id")).groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("groups"), F.min("cell_id").alias("result_id"), F.array_sort(F.collect_set("cell_id")).alias("source_ids"))
    status = F.when(F.col("n") < 2, "too_few_cells").when(F.col("groups") > 1, "somas_not_connected").otherwise("applied")
    audit = g.withColumn("status", status).drop("groups", "n")
    relabel = audit.where(F.col("status") == "applied").select("field_id", F.explode("source_ids").alias("cell_id"), "result_id")
    out = regions.join(relabel, CELL, "left").withColumn("cell_id", F.coalesce("result_id", "cell_id")).drop("result_id")
    return out, audit


def edit_trim(regions: DataFrame, strokes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete stroke pixels from processes unless that empties or newly disconnects a cell.

    ``strokes``: (field_id, y, x). A cell is refused with ``empty_processes`` or
    ``new_disconnection`` (a process pixel loses its path to the soma).
    """
    # Written once: the strokes and what they leave are read by both labellings and by the counts.
    cut = cut_lineage(regions.where(F.col("part") == "processes").join(strokes.select(*AT).distinct(), AT, "left_semi").select(*AT, "cell_id"))
    touched = cut.select(*CELL).distinct()
    base = cut_lineage(regions.join(touched, CELL, "left_semi"))
    after = cut_lineage(base.join(cut, [*AT, "cell_id"], "left_anti"))

    def reachable(px: DataFrame) -> DataFrame:
        lab = graph.components(px.select("field_id", "cell_id", "y", "x", "height", "width"), CELL, dense=False)
        seeds = lab.join(px.where(F.col("part") == "soma").select(*CELL, "y", "x"), [*CELL, "y", "x"], "left_semi").select(*CELL, "label_id").distinct()
        return lab.join(seeds, [*CELL, "label_id"], "left_semi").select(*CELL, "y", "x")

    left = after.where(F.col("part") == "processes").select(*CELL, "y", "x")
    lost = reachable(base).join(left, [*CELL, "y", "x"], "left_semi").join(reachable(after), [*CELL, "y", "x"], "left_anti")
    n_left = left.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_left"))
    n_lost = lost.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_lost"))
    audit = cut.groupBy(*CELL).agg(F.count(F.lit(1)).alias("deleted_px")).join(n_left, CELL, "left").join(n_lost, CELL, "left").withColumn(
        "error", first_reason(("empty_processes", F.col("_left").isNull()), ("new_disconnection", F.coalesce("_lost", F.lit(0)) > 0))).drop("_left", "_lost")
    fine = audit.where(F.col("error").isNull()).select(*CELL)
    return regions.join(cut.join(fine, CELL, "left_semi"), [*AT, "cell_id"], "left_anti"), audit


def renumber(ids: DataFrame, keys: list[str] = FIELD, old: str = "cell_id") -> DataFrame:
    """Dense new ids in original order: (keys, old_id, new_id)."""
    from rasterspark.functions.quantile import dense_index

    return dense_index(ids.select(*keys, F.col(old).cast("long").alias("old_id")).distinct(), keys, "old_id", "new_id")


# -------------------------------------------------------------------- identity


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) as a column expression."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant,
        F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def initial_identity(cells: DataFrame, namespace: str, scope: str | Column) -> DataFrame:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    uid = uuid5(namespace, F.concat(F.lit("initial:"), scope, F.lit(":"), F.col("cell_id").cast("string")))
    return cells.withColumns({"cell_uid": uid}).withColumns({"parent_uid": F.lit(None).cast("string"), "lineage": F.array("cell_uid")})


def split_identity(children: DataFrame, namespace: str) -> DataFrame:
    """Child identities: (parent_uid, parent_lineage, owner_uid, child_index, nonce)."""
    seed = F.concat_ws(":", F.lit("split"), "parent_uid", "nonce", F.col("child_index").cast("string"), "owner_uid")
    return children.withColumns({
        "cell_uid": uuid5(namespace, seed), "lineage": F.array_distinct(F.concat("parent_lineage", F.array("parent_uid")))})


def merge_identity(sources: DataFrame, namespace: str, keys: list[str]) -> DataFrame:
    """Merged identity per group: (keys, cell_uid, lineage, nonce)."""
    g = sources.groupBy(*keys, "nonce").agg(F.array_sort(F.collect_list(F.struct("cell_uid", "lineage"))).alias("_s"))
    uids = F.transform("_s", lambda s: s["cell_uid"])
    merged = F.array_distinct(F.flatten(F.transform("_s", lambda s: F.concat(s["lineage"], F.array(s["cell_uid"])))))
    seed = F.concat(F.lit("merge:"), F.col("nonce"), F.lit(":"), F.array_join(uids, ","))
    return g.select(*keys, uuid5(namespace, seed).alias("cell_uid"), merged.alias("lineage"))


def lineage_maps(identities: DataFrame, originals: DataFrame) -> DataFrame:
    """Where every source id went: (field_id, source_id, final_ids, status).

    ``identities``: (field_id, label_id, original_id, lineage ARRAY).
    """
    s = identities.select("field_id", F.explode("lineage").alias("source_id"), "label_id").groupBy("field_id", "source_id").agg(
        F.array_sort(F.collect_set("label_id")).alias("final_ids"))
    j = originals.select("field_id", F.col("original_id").alias("source_id")).join(s, ["field_id", "source_id"], "left")
    return j.withColumn("status", F.when(F.col("final_ids").isNull(), "deleted").when(F.size("final_ids") > 1, "split").otherwise("kept"))


def state_hash(rows: DataFrame, columns: list[str], keys: list[str] = FIELD, shard: int = 256) -> DataFrame:
    """Order-free content hash of a table per key.

    Rows are hashed, shards of rows are combined first, and only at most
    ``shard`` shard hashes meet per key.
    """
    # Each value goes with its length, so no two rows have one text.
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    text = F.sha2(F.concat(*[part(F.col(c).cast("string")) for c in columns]), 256)
    r = rows.select(*keys, text.alias("h")).withColumn("_b", F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % F.lit(shard * 64))
    combined = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256)
    # A row travels once, as 32 bytes: the inner shards of an outer one lie in one task.
    text = F.lower(F.hex("h")).alias("h")
    r = r.select(*keys, (F.col("_b") % shard).cast("int").alias("_m"), "_b", F.unhex("h").alias("h")).repartition(*keys, "_m")
    inner = r.select(*keys, "_m", "_b", text).groupBy(*keys, "_m", "_b").agg(combined.alias("h"))
    mid = inner.groupBy(*keys, "_m").agg(F.unhex(combined).alias("h"))
    last = F.transform(F.sort_array(F.collect_list("h")), lambda v: F.lower(F.hex(v)))
    return mid.groupBy(*keys).agg(F.sha2(F.array_join(last, ","), 256).alias("state_hash"))


def transport_identity(results: DataFrame, prior: DataFrame) -> DataFrame:
    """Original id and lineage of every edited cell.

    A known uid keeps its original id, the first child of a split takes its
    parent's, a merge takes the lowest source; everything that would repeat an id
    takes the next free one in display order, and so does a cell without any origin. ``results``: (field_id, label_id,
    cell_uid, parent_uid, sources ARRAY of uids); ``prior``: (field_id, cell_uid,
    original_id, lineage ARRAY).
    """
    p = lambda n: prior.select("field_id", F.col("cell_uid").alias(n), F.col("original_id").alias(f"_{n}_o"), F.col("lineage").alias(f"_{n}_l"))
    j = results.join(p("cell_uid"), ["field_id", "cell_uid"], "left").join(p("parent_uid"), ["field_id", "parent_uid"], "left")
    src = results.select("field_id", "label_id", F.explode("sources").alias("s")).join(p("s"), ["field_id", "s"]).groupBy("field_id", "label_id").agg(
        F.min("_s_o").alias("_m_o"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s_l")))).alias("_m_l"))
    j = j.join(src, ["field_id", "label_id"], "left")
    wish = F.coalesce("_cell_uid_o", "_parent_uid_o", "_m_o")
    lineage = F.coalesce("_cell_uid_l", "_parent_uid_l", "_m_l")
    first = Window.partitionBy("field_id", "_wish").orderBy("label_id")
    j = j.withColumn("_wish", wish).withColumn("_dup", F.col("_wish").isNull() | (F.row_number().over(first) > 1))
    top = prior.groupBy("field_id").agg(F.max("original_id").alias("_top"))
    fresh = F.sum(F.col("_dup").cast("int")).over(Window.partitionBy("field_id").orderBy("label_id"))
    j = j.join(top, "field_id", "left").withColumn("original_id", F.when(F.col("_dup"), F.coalesce("_top", F.lit(0)) + fresh).otherwise(F.col("_wish")))
    return j.select("field_id", "label_id", "original_id", "cell_uid", "parent_uid", lineage.alias("lineage"))


# ---------------------------------------------------------------------- ledger


def content_hash(rows: DataFrame, columns: list[str], keys: list[str] = FIELD) -> DataFrame:
    """Order-free hash of a set of distinct rows per key that edits can update: (keys, c1, c2).

    The hash of a set is the exclusive or of its rows' hashes, so the hash after an edit
    is the one before combined with the rows that the edit takes and brings
    (``content_delta``); nothing else is read again.
    """
    lane = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    return rows.groupBy(*keys).agg(lane(1).alias("c1"), lane(2).alias("c2"))


def content_delta(before: DataFrame, after: DataFrame, columns: list[str], keys: list[str] = FIELD) -> DataFrame:
    """What an edit changes in ``content_hash``: (keys, c1, c2) of the rows that only one side has."""
    side = lambda df, n: df.select(*keys, *columns).distinct().withColumn("_side", F.lit(n))
    both = side(before, 0).unionByName(side(after, 1)).groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n"))
    return content_hash(both.where("_n = 1"), columns, keys)


PROPOSAL = ("base_version", "base_c1", "base_c2", "result_version", "result_c1", "result_c2", "delta_c1", "delta_c2")


def accept_proposals(proposals: DataFrame, initial: DataFrame) -> DataFrame:
    """Commits and reverts of a ledger under version and content gates, in sequence order.

    ``proposals``: (field_id, sequence, action, PROPOSAL); ``initial``: (field_id, version,
    c1, c2). A commit must name the current version (else ``stale_version``) and content
    (``foreign_content``), promise the next version (``wrong_revision``) and a result that its
    own delta gives (``tampered_result``). A revert must find the state as its commit left it
    (``changed_since_commit``), restores the content before it and takes a new version. Fields
    without an initial state begin empty at version 0.

    Rows stream in (field, sequence) order; the state of a field is its content, its version and
    two contents a commit that can still be undone.
    """
    start = initial.select("field_id", *[F.col(c).cast("long").alias(f"_{c}") for c in ("version", "c1", "c2")])
    names = ["field_id", "sequence", "action", *PROPOSAL, "_version", "_c1", "_c2"]
    j = proposals.join(start, "field_id", "left").select("field_id", F.col("sequence").cast("long").alias("sequence"), "action", *[F.col(c).cast("long").alias(c) for c in PROPOSAL], *[
        F.coalesce(f"_{c}", F.lit(0).cast("long")).alias(f"_{c}") for c in ("version", "c1", "c2")])
    schema = "field_id string, sequence bigint, accepted boolean, status string, version bigint, c1 bigint, c2 bigint, depth bigint"

    def run(batches):
        current, version, content, undo = None, 0, (0, 0), []
        for b in batches:
            out = []
            for row in zip(*(b.column(n).to_pylist() for n in names)):
                field, sequence, action, base, b1, b2, result, r1, r2, d1, d2, v0, c1, c2 = row
                if field != current:
                    current, version, content, undo = field, v0, (c1, c2), []
                if action == "revert":
                    if not undo:
                        status = "nothing_to_revert"
                    elif undo[-1][:2] != (version, content):
                        status = "changed_since_commit"
                    else:
                        status, version, content = "reverted", version + 1, undo.pop()[2]
                elif base != version:
                    status = "stale_version"
                elif (b1, b2) != content:
                    status = "foreign_content"
                elif result != version + 1:
                    status = "wrong_revision"
                elif (r1, r2) != (content[0] ^ d1, content[1] ^ d2):
                    status = "tampered_result"
                else:
                    before, version, content = content, result, (r1, r2)
                    undo.append((version, content, before))
                    status = "committed"
                out.append((field, sequence, status in ("committed", "reverted"), status, version, *content, len(undo)))
            cols = list(zip(*out)) if out else [()] * 8
            types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["field_id", "sequence", "accepted", "status", "version", "c1", "c2", "depth"])

    return j.repartition("field_id").sortWithinPartitions("field_id", "sequence").mapInArrow(run, schema)


def _accept_unversioned(edits: DataFrame) -> DataFrame:
    """Acceptance of logs without base versions by windows alone.

    A revert at depth 0 is refused, so depth is the running sum of +1 and -1 above its own running
    minimum (never above 0), and a refusal is where that minimum falls.
    """
    w = Window.partitionBy("field_id").orderBy("sequence")
    e = edits.withColumn("_sum", F.sum(F.when(F.col("revert"), -1).otherwise(1)).over(w))
    e = e.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(w)))
    refused = F.col("revert") & (F.col("_low") < F.coalesce(F.lag("_low").over(w), F.lit(0)))
    e = e.withColumn("accepted", ~refused)
    status = F.when(F.col("accepted"), "accepted").otherwise("nothing_to_revert")
    return e.select("field_id", "sequence", "accepted", status.alias("status"), F.sum(F.col("accepted").cast("long")).over(w).alias("version"), (F.col("_sum") - F.col("_low")).cast("long").alias("depth"))


def accept_edits(edits: DataFrame) -> DataFrame:
    """Sequential acceptance of an edit log: stale versions and empty reverts are refused.

    ``edits``: (field_id, sequence, action, base_version); a revert pops the last
    commit. Fields without any base version are decided by windows. The others stream
    through in (field, sequence) order with two counters of state per field, so a long
    log is never held in memory.
    """
    slim = edits.select("field_id", "sequence", (F.col("action") == "revert").alias("revert"), F.col("base_version").cast("long").alias("base_version"))
    versioned = slim.where(F.col("base_version").isNotNull()).select("field_id").distinct()
    schema = "field_id string, sequence bigint, accepted boolean, status string, version bigint, depth bigint"

    def run(batches):
        current, version, depth = None, 0, 0
        for b in batches:
            out = []
            for f, s, rev, base in zip(*(b.column(i).to_pylist() for i in range(4))):
                if f != current:
                    current, version, depth = f, 0, 0
                if base is not None and base != version:
                    status = "stale_version"
                elif rev and depth == 0:
                    status = "nothing_to_revert"
                else:
                    status = "accepted"
                    version, depth = version + 1, depth + (-1 if rev else 1)
                out.append((f, s, status == "accepted", status, version, depth))
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["field_id", "sequence", "accepted", "status", "version", "depth"])

    streamed = slim.join(versioned, "field_id", "left_semi").select("field_id", F.col("sequence").cast("long").alias("sequence"), "revert", "base_version")
    streamed = streamed.repartition("field_id").sortWithinPartitions("field_id", "sequence").mapInArrow(run, schema)
    return streamed.unionByName(_accept_unversioned(slim.join(versioned, "field_id", "left_anti")))


def apply_ledger(edits: DataFrame) -> DataFrame:
    """Audit rows of a ledger with ``reverted``: a commit is undone when the stack later falls below it."""
    a = accept_edits(edits)
    k = ["field_id", "sequence"]
    # Reading backwards, the running minimum of the later depths tells what survives.
    later = Window.partitionBy("field_id").orderBy(F.desc("sequence")).rowsBetween(Window.unboundedPreceding, -1)
    low = F.min(F.when(F.col("accepted"), F.col("depth"))).over(later)
    j = a.withColumn("_low", low).join(edits.drop("base_version"), k)
    reverted = F.col("accepted") & (F.col("action") != "revert") & F.coalesce(F.col("_low") < F.col("depth"), F.lit(False))
    return j.withColumn("reverted", reverted).drop("_low")


def trim_reasons(process_px: Column, lost_px: Column) -> Column:
    return reasons(("empty_processes", process_px == 0), ("new_disconnection", lost_px > 0))
