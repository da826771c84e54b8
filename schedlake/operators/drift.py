"""Schemas that drift between exports: versioned fingerprints, migration steps, one table.

Every export of a table gets a fingerprint of its field names and their value types. Exports of
a programme whose fingerprint equals the one before belong to the same schema version; only
where it differs are two exports compared, and each difference becomes a migration step
(rename, default, drop, cast). The steps chain: a field is followed through its renames, drops
and returns to one identity with one final name and type, and every file is routed through the
chain of its own version. Whole tables are read where they lie; only field lists and counts are
shuffled, and cells only of exports in which fields both came and went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.dates import CLOCK
from schedlake.functions.numbers import NUMBER, blank_trim, is_number, let, to_number
from schedlake.operators.carry import carry_forward, previous_row
from schedlake.operators.hierarchy import component_roots
from schedlake.operators.skew import lookup
from schedlake.session import spread, store

#: The field whose cells name a table's rows across exports.
ROW_KEYS = {"PROJECT": "proj_id", "PROJWBS": "wbs_id", "TASK": "task_id", "TASKPRED": "task_pred_id"}
#: Share of comparable cells that must agree for two names to be one field, and of cells that must fit a field's final type.
SAME_CONTENT, FITTING = 0.8, 0.8
#: In order of preference on ties.
TYPES = ("number", "stamp", "flag", "text")
#: Kinds of cells by letter; those of one type stand together. b is 0 or 1, u a number in words (12 hrs, ID-12, 1,5), w true or false.
KINDS = {"number": "nb", "stamp": "s", "flag": "f", "text": "tuw"}
_LETTERS = "".join(KINDS.values())
_STAMP = rf"\A(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {CLOCK}\z"
_WORDED = r"\A(?:[A-Za-z]{1,4}-)?([+-]?[0-9]+(?:[.,][0-9]+)?) ?[A-Za-z%]{0,5}\z"
#: Numbers from which a point in time is counted in seconds since 1970, below it in days since 1899-12-30.
_SECONDS = 1e7


def _is_stamp(body: Column) -> Column:
    return body.rlike(_STAMP) & F.substring(body, 1, 10).try_cast("date").isNotNull()


def cell_kind(body: Column) -> Column:
    """The letter of a trimmed cell's kind, null for an empty cell; cheap tests come first."""
    return (
        F.when(F.coalesce(body, F.lit("")) == "", F.lit(None).cast("string"))
        .when(body.isin("0", "1"), "b")
        .when(body.rlike(NUMBER), "n")
        .when(body.isin("Y", "N"), "f")
        .when((F.length(body) == 16) & _is_stamp(body), "s")
        .when(body.isin("true", "false"), "w")
        .when(body.rlike(_WORDED), "u")
        .otherwise("t")
    )


def _written(number: Column, body: Column) -> Column:
    """A number written alike everywhere: 80.00 is 80; ``body`` where it is no number."""
    return let(number, lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(F.coalesce(n.cast("string"), body)))


def canonical_value(cell: Column) -> Column:
    """A cell reduced to what it says: 80 and 80.00 are both 80; empty is null."""
    return let(F.nullif(blank_trim(cell), F.lit("")), lambda body: _written(to_number(body), body))


def cast_value(cell: Column, kind: Column) -> Column:
    """A cell in its field's final type, written alike everywhere; null where it does not fit.

    number: also with a unit, a prefix or a decimal comma. flag: also 1 and 0, true and false.
    stamp: also seconds since 1970 and days since 1899-12-30. text: anything.
    """

    def cast(body: Column) -> Column:
        number = to_number(body)
        worded = F.regexp_replace(F.nullif(F.regexp_extract(body, _WORDED, 1), F.lit("")), ",", ".").try_cast("double")
        low = F.lower(body)
        seconds = F.when(number >= _SECONDS, number).otherwise(F.round((number - 25569) * 1440) * 60)
        moment = F.date_format(F.timestamp_seconds(seconds).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm")
        return (
            F.when(kind == "number", _written(F.coalesce(number, worded), F.lit(None).cast("string")))
            .when(kind == "flag", F.when(low.isin("y", "1", "true"), "Y").when(low.isin("n", "0", "false"), "N"))
            .when(kind == "stamp", F.when(_is_stamp(body), body).when(number.between(1, 1e11), moment))
            .otherwise(_written(number, body))
        )

    return let(F.nullif(blank_trim(cell), F.lit("")), cast)


# ---------------------------------------------------------------- exports and versions


def _names(fields: str) -> Column:
    return F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.lower(blank_trim(F.coalesce(f, F.lit("")))))


def _place(names: Column, name: Column) -> Column:
    return F.array_position(names, name).cast("int") - 1


def declarations(xer_table: DataFrame) -> DataFrame:
    """Every distinct declaration of a table in a file: its names and, per name, how many cells are of each kind.

    Columns: file_id, table_name, content (a hash; repeated rows count once), seq_no, names
    (lower case, blanks dropped, the first of a repeated name), counts (aligned to names, in the
    order of ``KINDS``'s letters). Null field lists or cells count as empty.
    """
    cells = F.coalesce("cells", F.array().cast("array<array<string>>"))
    some = spread(xer_table.where("file_id IS NOT NULL AND table_name IS NOT NULL").select("file_id", "table_name", "seq_no", "fields", "cells"))
    rows = some.select("file_id", "table_name", "seq_no", F.xxhash64("fields", "cells").alias("content"), _names("fields").alias("every"), cells.alias("cells"))
    rows = rows.withColumn("names", F.array_distinct("every"))
    rows = rows.withColumn("places", F.transform("names", lambda n: _place(F.col("every"), n)))

    def counts(place: Column) -> Column:
        bodies = F.transform("cells", lambda row: blank_trim(F.get(row, place)))
        letters = F.array_join(F.transform(bodies, cell_kind), "")
        return let(letters, lambda s: F.array(*[F.length(s) - F.length(F.translate(s, k, "")) for k in _LETTERS]))

    light = rows.select("file_id", "table_name", "content", "seq_no", "names", F.transform("places", counts).alias("counts"))
    return light.groupBy("file_id", "table_name", "content", "names", "counts").agg(F.min("seq_no").alias("seq_no"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, b: a + b)


def _of_type(counts: Column, kind: str) -> Column:
    return sum((F.get(counts, F.lit(_LETTERS.index(k))) for k in KINDS[kind]), F.lit(0))


def _dominant(counts: Column) -> Column:
    """The type of most cells, null where there are none; ties go to the first of ``TYPES``."""
    by = F.array(*[_of_type(counts, t) for t in TYPES])
    return let(by, lambda b: let(F.array_max(b), lambda top: F.when(top > 0, F.get(F.array(*[F.lit(t) for t in TYPES]), _place(b, top)))))


def exports(xer_table: DataFrame, revision: DataFrame) -> DataFrame:
    """One row per (file, table) of a programme, without its cells.

    Columns: programme_id, rev_no, p6_version (its number alone, null where none is given),
    file_id, table_name, names, counts, types, fingerprint. A table declared again in a file
    adds its cells to the first declaration by name, and the names that one lacks behind it.
    Files without a revision or a programme are left out.
    """
    parts = declarations(xer_table).groupBy("file_id", "table_name").agg(F.array_sort(F.collect_list(F.struct("seq_no", "content", "names", "counts"))).alias("parts"))
    none = F.array(*[F.lit(0)] * len(_LETTERS))

    def added(name: Column) -> Column:
        mine = lambda part: F.coalesce(F.get(part["counts"], F.when(F.array_contains(part["names"], name), _place(part["names"], name))), none)
        return F.aggregate("parts", none, lambda have, part: F.zip_with(have, mine(part), lambda a, b: a + b))

    one = F.size("parts") == 1
    names = F.when(one, F.get("parts", F.lit(0))["names"]).otherwise(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["names"]))))
    whole = parts.withColumn("names", names).withColumn("counts", F.when(one, F.get("parts", F.lit(0))["counts"]).otherwise(F.transform("names", added)))
    whole = whole.withColumn("types", F.transform("counts", _dominant))
    typed = F.array_sort(F.zip_with("names", "types", lambda n, t: F.concat_ws("\t", n, F.coalesce(t, F.lit("")))))
    version = F.nullif(F.regexp_extract("p6_version", r"[0-9]+\.[0-9]+", 0), F.lit("")) if "p6_version" in revision.columns else F.lit(None).cast("string")
    revs = revision.where("file_id IS NOT NULL AND programme_id IS NOT NULL").groupBy("file_id").agg(F.min(F.struct("programme_id", "rev_no", version.alias("p6_version"))).alias("r"))
    return whole.join(revs, "file_id").select("r.*", "file_id", "table_name", "names", "counts", "types", F.sha2(F.array_join(typed, "\n"), 256).alias("fingerprint"))


def neighbours(exported: DataFrame) -> DataFrame:
    """Each export beside the nearest earlier one of its programme that holds the same table, as ``before``."""
    value = F.struct("file_id", "rev_no", "names", "counts", "fingerprint")
    return previous_row(exported, ["programme_id", "table_name"], "rev_no", ["rev_no", "file_id"], value, "before")


def version_members(paired: DataFrame) -> DataFrame:
    """Each export with ``version_file``, the export that began its schema version: the last one at or before it whose
    fingerprint differs from its predecessor's."""
    begins = F.coalesce(F.col("fingerprint") != F.col("before.fingerprint"), F.lit(True))
    events = {"version_file": F.when(begins, F.col("file_id"))}
    return carry_forward(paired, ["programme_id", "table_name"], "rev_no", ["rev_no", "file_id"], events, chunk=256)


def versions(paired: DataFrame) -> DataFrame:
    """The schema versions: programme_id, table_name, version_no (from 1), file_id and rev_no of the export that began it, fingerprint,
    names, types, n_exports, p6_versions (as told by its exports' revisions, which need not agree)."""
    paired = store(version_members(paired))
    members = paired.groupBy(F.col("version_file").alias("file_id"), "table_name").agg(F.count("*").alias("n_exports"), F.array_sort(F.collect_set("p6_version")).alias("p6_versions"))
    first = paired.where("file_id = version_file").select("programme_id", "table_name", "file_id", "rev_no", "fingerprint", "names", "types")
    order = Window.partitionBy("programme_id", "table_name").orderBy("rev_no", "file_id")
    return first.withColumn("version_no", F.row_number().over(order)).join(members, ["file_id", "table_name"])


# ---------------------------------------------------------------- changes and steps


def _renames(todo: DataFrame, xer_table: DataFrame) -> DataFrame:
    """``(file_id, table_name, old_name, new_name)``: same content under another name.

    ``todo`` holds the exports with fields both added and removed; only their rows and those of
    the exports before them are opened. Rows meet on the table's key field where both have it,
    else by position, one row a key; agreeing cells are counted per pair of names, and a pair
    is kept when each is the other's best match.
    """
    keys = F.create_map(*[F.lit(x) for kv in ROW_KEYS.items() for x in kv])[F.col("table_name")]
    keyed = F.array_contains("names", keys) & F.array_contains("before.names", keys)
    side = lambda file, wanted, role: F.struct(F.col(file).alias("at_file"), F.col(wanted).alias("wanted"), F.lit(role).alias("role"))
    sides = todo.select(
        "file_id", "table_name", F.when(keyed, keys).alias("key_name"), F.explode(F.array(side("file_id", "added", "new"), side("before.file_id", "removed", "old"))).alias("side")
    ).select("file_id", F.col("table_name").alias("of_table"), "key_name", "side.*")
    opened = sides.select(F.col("at_file").alias("o_file"), F.col("of_table").alias("o_table")).distinct()
    rows = xer_table.join(opened, (F.col("file_id") == F.col("o_file")) & (F.col("table_name") == F.col("o_table")), "left_semi")
    rows = rows.groupBy(F.col("file_id").alias("c_file"), F.col("table_name").alias("c_table"), F.xxhash64("fields", "cells")).agg(F.first(_names("fields")).alias("every"), F.first("cells").alias("cells"))
    met = sides.join(rows, (F.col("at_file") == F.col("c_file")) & (F.col("of_table") == F.col("c_table")))
    place = lambda name: F.when(F.array_contains("every", name), _place(F.col("every"), name))
    met = met.withColumns({"key_at": place(F.col("key_name")), "wanted": F.transform("wanted", lambda n: F.struct(n.alias("name"), place(n).alias("place")))})
    met = met.select("file_id", F.col("of_table").alias("table_name"), "key_name", "key_at", "role", "wanted", F.posexplode("cells").alias("pos", "row"))
    row_key = F.when(F.col("key_name").isNotNull(), F.coalesce(canonical_value(F.get("row", F.col("key_at"))), F.lit(""))).otherwise(F.col("pos").cast("string"))
    vals = F.transform("wanted", lambda w: F.struct(w["name"].alias("name"), canonical_value(F.get("row", w["place"])).alias("val")))
    values = met.select("file_id", "table_name", "role", row_key.alias("row_key"), F.struct("pos", vals.alias("vals")).alias("x"))
    # One row a key and side, so a key that repeats makes no pairs of rows.
    one = lambda role: F.min(F.when(F.col("role") == role, F.col("x")))["vals"]
    both = values.groupBy("file_id", "table_name", "row_key").agg(one("new").alias("news"), one("old").alias("olds")).where("news IS NOT NULL AND olds IS NOT NULL")
    cross = both.select("file_id", "table_name", F.explode("news").alias("n"), "olds").select("file_id", "table_name", "n", F.explode("olds").alias("o"))
    counted = cross.where("n.val IS NOT NULL OR o.val IS NOT NULL").groupBy(
        "file_id", "table_name", F.col("o.name").alias("old_name"), F.col("n.name").alias("new_name")
    ).agg(F.avg(F.when(F.col("n.val") == F.col("o.val"), 1.0).otherwise(0.0)).alias("score"))
    scored = counted.where(F.col("score") >= SAME_CONTENT)
    order = [F.desc("score"), F.levenshtein("old_name", "new_name"), "old_name", "new_name"]
    ranked = scored.withColumns(
        {
            "by_new": F.row_number().over(Window.partitionBy("file_id", "table_name", "new_name").orderBy(*order)),
            "by_old": F.row_number().over(Window.partitionBy("file_id", "table_name", "old_name").orderBy(*order)),
        }
    )
    return ranked.where("by_new = 1 AND by_old = 1").select("file_id", "table_name", "old_name", "new_name")


def paired_exports(xer_table: DataFrame, revision: DataFrame) -> DataFrame:
    """The stored ``neighbours`` of all exports: what every other step reads."""
    return store(neighbours(store(exports(xer_table, revision))))


def changes(xer_table: DataFrame, revision: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """Every schema change, one row a case.

    Columns: programme_id, rev_no, file_id, old_file_id, table_name, change_kind (added,
    removed, renamed, retyped), field_name (the earlier name for removed and renamed), new_name
    (renamed only), old_type and new_type (retyped only). Order and letter case are no changes.
    Exports with the fingerprint of their predecessor have none and are not compared.
    """
    paired = paired_exports(xer_table, revision) if paired is None else paired
    pairs = paired.where("before.fingerprint <> fingerprint").withColumns({"added": F.array_except("names", "before.names"), "removed": F.array_except("before.names", "names")})
    todo = pairs.where((F.size("added") > 0) & (F.size("removed") > 0)).select("file_id", "table_name", "names", "before", "added", "removed")
    renames = _renames(store(todo), xer_table).groupBy("file_id", "table_name").agg(F.sort_array(F.collect_list(F.struct("old_name", "new_name"))).alias("renames"))
    pairs = pairs.join(renames, ["file_id", "table_name"], "left").withColumn(
        "renames", F.coalesce("renames", F.array().cast("array<struct<old_name:string,new_name:string>>"))
    )
    none = F.lit(None).cast("string")
    case = lambda kind, field, new=none, old_type=none, new_type=none: F.struct(
        F.lit(kind).alias("change_kind"), field.alias("field_name"), new.alias("new_name"), old_type.alias("old_type"), new_type.alias("new_type")
    )
    olds, news = F.transform("renames", lambda r: r["old_name"]), F.transform("renames", lambda r: r["new_name"])
    kept = F.transform(F.array_intersect("names", "before.names"), lambda n: F.struct(
        n.alias("name"), F.get("before.counts", _place(F.col("before.names"), n)).alias("old"), F.get("counts", _place(F.col("names"), n)).alias("new")
    ))
    typed = F.transform(kept, lambda k: F.struct(k["name"].alias("name"), _dominant(k["old"]).alias("old_type"), _dominant(k["new"]).alias("new_type"), k["new"].alias("new")))
    of_old = lambda k: sum((F.when(k["old_type"] == t, _of_type(k["new"], t)).otherwise(0) for t in TYPES), F.lit(0))
    retyped = F.filter(typed, lambda k: (k["old_type"] != k["new_type"]) & (2 * (_total(k["new"]) - of_old(k)) > _total(k["new"])))
    cases = F.concat(
        F.transform(F.array_except("added", news), lambda n: case("added", n)),
        F.transform(F.array_except("removed", olds), lambda n: case("removed", n)),
        F.transform("renames", lambda r: case("renamed", r["old_name"], r["new_name"])),
        F.transform(retyped, lambda k: case("retyped", k["name"], none, k["old_type"], k["new_type"])),
    )
    return pairs.select(
        "programme_id", "rev_no", "file_id", F.col("before.file_id").alias("old_file_id"), "table_name", F.explode(cases).alias("c")
    ).select("programme_id", "rev_no", "file_id", "old_file_id", "table_name", "c.*")


def migration_steps(changed: DataFrame) -> DataFrame:
    """Changes as steps from one schema version to the next, in the order they run: rename, default, drop, cast."""
    kinds = ("renamed", "rename"), ("added", "default"), ("removed", "drop"), ("retyped", "cast")
    step = F.create_map(*[F.lit(x) for pair in kinds for x in pair])[F.col("change_kind")]
    place = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(kinds, 1) for x in (k, i)])[F.col("change_kind")]
    return changed.select(
        "programme_id", "table_name", "rev_no", "file_id", place.alias("step_no"), step.alias("step"), "field_name",
        F.when(F.col("change_kind") == "renamed", F.col("new_name")).when(F.col("change_kind") == "retyped", F.col("new_type")).alias("target"),
    )


# ---------------------------------------------------------------- the chain


def _node(name: str, file: str) -> Column:
    return F.to_json(F.array("programme_id", "table_name", name, F.col(file).cast("string")))


def lineage(paired: DataFrame, changed: DataFrame) -> DataFrame:
    """Every field of every schema version with its identity's final name and type.

    Columns: programme_id, table_name, file_id (the export that began the version), rev_no,
    name, final_name, final_type. A name lives from where it is added, or another is renamed
    to it, to where it is dropped or renamed. A life continues the one it was renamed from, and
    the one of the same name that was dropped before it; a name used anew after a rename is
    another field. An identity's final name is that of its latest life; of identities that end
    at one name the latest keeps it and the others get their first revision behind it. The
    final type is stamp, flag or number where a version had it and four fifths of the cells of
    all versions fit it, else text. Chains are followed by pointer doubling.
    """
    group = ["programme_id", "table_name"]
    event = lambda name, seq, kind, to: F.struct(name.alias("name"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), to.alias("to"))
    none = F.lit(None).cast("string")
    field, new = F.col("field_name"), F.col("new_name")
    # At one revision: look up the life to continue (0), end lives (1), start lives (2), read what lives (3).
    events = changed.where("change_kind <> 'retyped'").select(*group, "rev_no", "file_id", F.explode(
        F.when(F.col("change_kind") == "renamed", F.array(event(field, 0, "renamed", new), event(field, 1, "renamed", none), event(new, 2, "start", none)))
        .when(F.col("change_kind") == "added", F.array(event(field, 0, "added", field), event(field, 2, "start", none)))
        .otherwise(F.array(event(field, 1, "dropped", none)))
    ).alias("e")).select(*group, "rev_no", "file_id", "e.*")
    begins = paired.where("before IS NULL OR fingerprint <> before.fingerprint")
    first = paired.where("before IS NULL").select(*group, "rev_no", "file_id", F.explode("names").alias("name"))
    began = begins.select(*group, "rev_no", "file_id", F.posexplode("names").alias("at", "name"), "counts")
    rows = events.withColumn("counts", F.lit(None).cast("array<int>")).unionByName(
        first.select(*group, "rev_no", "file_id", "name", F.lit(2).alias("seq"), F.lit("start").alias("kind"), none.alias("to"), F.lit(None).cast("array<int>").alias("counts"))
    ).unionByName(
        began.select(*group, "rev_no", "file_id", "name", F.lit(3).alias("seq"), F.lit("read").alias("kind"), none.alias("to"), F.get("counts", F.col("at")).alias("counts"))
    )
    starts = F.when(F.col("seq") == 2, F.struct("rev_no", "file_id"))
    state = F.when(F.col("seq").isin(1, 2), F.col("kind"))
    walked = store(carry_forward(rows, [*group, "name"], "rev_no", ["rev_no", "file_id", "seq"], {"life": starts, "state": state}, chunk=256))
    continues = walked.where("seq = 0 AND life IS NOT NULL AND (kind = 'renamed' OR state = 'dropped')")
    links = continues.select(_node("to", "file_id").alias("id"), _node("name", "life.file_id").alias("parent"))
    nodes = walked.where("seq = 2").select(_node("name", "file_id").alias("l_id"), *group, "name", "rev_no", "file_id").distinct()
    tree = component_roots(nodes.join(links, F.col("l_id") == F.col("id"), "left").select(F.col("l_id").alias("id"), "parent")).select(F.col("id").alias("t_id"), "root")
    lives = store(nodes.join(tree, F.col("l_id") == F.col("t_id")).drop("t_id"))
    ends = lives.groupBy(*group, "root").agg(F.max(F.struct("rev_no", "file_id", "name")).alias("last"), F.min("rev_no").alias("first_rev"))
    rank = F.row_number().over(Window.partitionBy(*group, "last.name").orderBy(F.desc("last.rev_no"), F.desc("last.file_id"), "root"))
    final = ends.select("root", F.when(rank == 1, F.col("last.name")).otherwise(F.concat_ws("@", "last.name", "first_rev", "root")).alias("final_name"))
    read = walked.where("seq = 3").select(*group, "file_id", "rev_no", "name", "counts", _node("name", "life.file_id").alias("r_id"))
    read = store(read.join(lives.select(F.col("l_id"), "root"), F.col("r_id") == F.col("l_id")).drop("r_id", "l_id"))
    had = lambda t: F.bool_or(_dominant(F.col("counts")) == t)
    fits = lambda kinds: F.sum(sum((F.get("counts", F.lit(_LETTERS.index(k))) for k in kinds), F.lit(0))) >= FITTING * F.sum(_total(F.col("counts")))
    types = read.groupBy(F.col("root").alias("y_root")).agg(
        F.when(had("stamp") & fits("snb"), "stamp").when(had("flag") & fits("fbw"), "flag").when(had("number") & fits("nbu"), "number").otherwise("text").alias("final_type")
    )
    out = read.join(final.withColumnRenamed("root", "z_root"), F.col("root") == F.col("z_root")).join(types, F.col("root") == F.col("y_root"))
    return out.select(*group, "file_id", "rev_no", "name", "final_name", "final_type")


def consistent_schema(fields: DataFrame) -> DataFrame:
    """``(programme_id, table_name, final_name, final_type, first_rev, last_rev)``: the one table's columns, and the versions that hold each."""
    return fields.groupBy("programme_id", "table_name", "final_name", "final_type").agg(F.min("rev_no").alias("first_rev"), F.max("rev_no").alias("last_rev"))


def consistent_rows(xer_table: DataFrame, revision: DataFrame) -> DataFrame:
    """Every row of every export as ``record``: final field name to value, one set of names a programme and table.

    Each file goes through the chain of its own schema version: names to final names, fields
    it lacks null (the default rule), values in their final types (the cast rule). A value that
    does not fit its type is null in ``record`` and kept as written in ``uncast``. Columns:
    programme_id, rev_no, file_id, table_name, seq_no, row_no, record, uncast. Repeated rows
    count once. Files without a revision or a programme keep their names, and their values are text.
    """
    paired = paired_exports(xer_table, revision)
    changed = store(changes(xer_table, revision, paired))
    fields = store(lineage(paired, changed))
    one = F.struct("name", "final_name", "final_type")
    maps = fields.groupBy(F.to_json(F.array("table_name", F.col("file_id").cast("string"))).alias("m_key")).agg(F.array_sort(F.collect_list(one)).alias("route"))
    owner = F.to_json(F.array("programme_id", "table_name"))
    whole = fields.select(owner.alias("s_key"), "final_name").groupBy("s_key").agg(F.array_sort(F.collect_set("final_name")).alias("schema"))
    light = version_members(paired).select("programme_id", "rev_no", F.col("file_id").alias("r_file"), F.col("table_name").alias("r_table"), F.to_json(F.array("table_name", F.col("version_file").cast("string"))).alias("version"), owner.alias("owner"))
    routes = lookup(lookup(light, "version", maps, "m_key"), "owner", whole, "s_key").select("programme_id", "rev_no", "r_file", "r_table", "route", "schema")
    rows = xer_table.where("file_id IS NOT NULL AND table_name IS NOT NULL").groupBy("file_id", "table_name", F.xxhash64("fields", "cells")).agg(
        F.min("seq_no").alias("seq_no"), F.first(_names("fields")).alias("every"), F.first("cells").alias("cells")
    )
    routed = rows.join(routes, (F.col("file_id") == F.col("r_file")) & (F.col("table_name") == F.col("r_table")), "left")
    own = F.transform(F.array_distinct("every"), lambda n: F.struct(n.alias("name"), n.alias("final_name"), F.lit("text").alias("final_type")))
    routed = routed.withColumn("route", F.coalesce("route", own)).withColumn("schema", F.coalesce("schema", F.array_distinct("every")))
    # Where each cell lies and where it goes is settled once an export, not once a row.
    plan = F.transform("route", lambda r: F.struct(
        r["final_name"].alias("field"), F.when(F.array_contains("every", r["name"]), _place(F.col("every"), r["name"])).alias("place"), r["final_type"].alias("kind")
    ))
    ends = F.transform("route", lambda r: r["final_name"])
    slots = let(ends, lambda e: F.transform("schema", lambda f: F.when(F.array_contains(e, f), _place(e, f))))
    planned = routed.withColumns({"plan": plan, "slots": slots})
    wide = planned.select("programme_id", "rev_no", "file_id", "table_name", "seq_no", "schema", "plan", "slots", F.posexplode("cells").alias("row_no", "row"))
    wide = wide.withColumn("raw", F.transform("plan", lambda p: F.nullif(blank_trim(F.get("row", p["place"])), F.lit(""))))
    wide = wide.withColumn("cast", F.zip_with("raw", "plan", lambda raw, p: cast_value(raw, p["kind"])))
    lost = F.filter(F.arrays_zip("plan", "raw", "cast"), lambda c: c["raw"].isNotNull() & c["cast"].isNull())
    return wide.select(
        "programme_id", "rev_no", "file_id", "table_name", "seq_no", "row_no",
        F.map_from_arrays("schema", F.transform("slots", lambda i: F.get("cast", i))).alias("record"),
        F.map_from_entries(F.transform(lost, lambda c: F.struct(c["plan"]["field"], c["raw"]))).alias("uncast"),
    )
