"""Screenplay operators: tiers, numbering, relations, rules, rendering (G-*, Q-*, R-*)."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import padded_id, trim
from foliant.operators.batches import met
from foliant.operators.relations import cooccurrence
from foliant.operators.runs import Runs
from foliant.sources.model import json_text
from foliant.sources.stage import staged

#: Codes and their labels.
SETTINGS = {"INT": "内", "EXT": "外", "INT/EXT": "内/外"}
TIMES = {"DAY": "日", "NIGHT": "夜", "DUSK": "黄昏", "DAWN": "黎明", "CONTINUOUS": "接", "LATER": "稍后"}
ELEMENTS = ("action", "dialogue", "dual_dialogue", "transition")
MODES = ("in_scene", "voiceover", "off_screen")


def confidence_tier(c: Column) -> Column:
    """P-10, T8: a missing confidence is full."""
    c = F.coalesce(c, F.lit(1.0))
    return F.when(c >= 0.7, "reliable").when(c >= 0.4, "review").otherwise("doubtful")


def label(code: Column, names: dict[str, str]) -> Column:
    """P-17: a code's label; an unknown code stays."""
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(names.items())))[code], code)


def renumber(rows: DataFrame, group: str, within: list[str | Column]) -> DataFrame:
    """G-03, W-01: ``number`` from 1 over groups in order, then within them.

    Rows are numbered inside their group; the group sizes are summed in ranges of
    groups and these by one row a range.
    """
    sizes = Runs(rows.groupBy(group).agg(F.count("*").alias("_n")), [], [group]).total("_upto", F.col("_n")).table()
    sizes = sizes.select(group, (F.col("_upto") - F.col("_n")).alias("_before"))
    k = F.row_number().over(W.partitionBy(group).orderBy(*within))
    return rows.withColumn("_k", k).join(sizes, group).withColumn("number", F.col("_before") + F.col("_k")).drop("_k", "_before")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a column project; a table without one is one project."""
    return rows if "project" in rows.columns else rows.withColumn("project", F.lit(""))


def names(characters: DataFrame) -> DataFrame:
    """(project, name, id): names and aliases; the last character of a project to
    use one owns it (T14)."""
    rows = keyed(characters).select("project", "ord", "id", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("p", "name"))
    return rows.where("name is not null").groupBy("project", "name").agg(F.max_by("id", F.struct("ord", "p")).alias("id"))


def named_in(texts: DataFrame, owned: DataFrame) -> DataFrame:
    """(project, scene, id) of the names that occur in a scene's texts: each text
    is tried against the names of its own project, which travel as one array."""
    by = owned.groupBy("project").agg(F.collect_list(F.struct("name", "id")).alias("owned"))
    found = F.transform(F.filter("owned", lambda x: F.contains(F.col("text"), x["name"])), lambda x: x["id"])
    return texts.join(met(by), "project").select("project", "scene", F.explode(F.array_distinct(found)).alias("id")).distinct()


def speakers(elements: DataFrame) -> DataFrame:
    """G-08: (project, scene, id) of who speaks in a scene."""
    said = keyed(elements).where("type in ('dialogue', 'dual_dialogue') and character is not null and character <> ''")
    return said.select("project", "scene", F.col("character").alias("id")).distinct()


def acted(elements: DataFrame) -> DataFrame:
    return keyed(elements).where("type = 'action' and text is not null").select("project", "scene", "text")


def appearances(elements: DataFrame, characters: DataFrame) -> DataFrame:
    """(project, scene, id) of speakers and of characters named in action texts."""
    return speakers(elements).union(named_in(acted(elements), names(characters))).distinct()


def relations(elements: DataFrame, characters: DataFrame) -> DataFrame:
    """G-06, X-21: (project, source, target, weight, label)."""
    one = appearances(elements, characters).withColumn("place", F.struct("project", "scene"))
    e = cooccurrence(one.select("place", F.struct("project", "id").alias("who")), "place", "who")
    e = e.select(F.col("source.project").alias("project"), F.col("source.id").alias("source"), F.col("target.id").alias("target"), "weight")
    return e.withColumn("label", F.concat(F.col("weight").cast("string"), F.lit(" 场同框")))


def relation_nodes(elements: DataFrame, characters: DataFrame) -> DataFrame:
    """G-06, I-04: (project, id, degree): all characters of the table and all who
    appear, also those without an edge."""
    e = relations(elements, characters)
    both = e.select("project", F.col("source").alias("id"), F.col("target").alias("o")).union(e.select("project", F.col("target").alias("id"), F.col("source").alias("o")))
    nodes = keyed(characters).select("project", "id").union(appearances(elements, characters).select("project", "id")).distinct()
    return nodes.join(both.groupBy("project", "id").agg(F.count_distinct("o").alias("degree")), ["project", "id"], "left").select("project", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def first_appearance(elements: DataFrame, characters: DataFrame) -> DataFrame:
    """G-07, W-08: (project, id, first): the first scene whose action texts name a
    character; a blank name is nobody's."""
    needles = keyed(characters).select("project", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where(F.length(trim(F.col("name"))) > 0)
    return named_in(acted(elements), needles).groupBy("project", "id").agg(F.min("scene").alias("first"))


def speaks_early(elements: DataFrame, characters: DataFrame) -> DataFrame:
    """Q-27: (project, scene, id) of speakers not named in an action text up to
    then."""
    got = speakers(elements).join(met(first_appearance(elements, characters)), ["project", "id"], "left")
    return got.where(F.col("first").isNull() | (F.col("first") > F.col("scene"))).select("project", "scene", "id")


def blank(c: Column) -> Column:
    return F.coalesce(F.length(trim(c)) == 0, F.lit(True))


def at(kind: str, *columns: str) -> Column:
    """The text ``kind`` with the numbers of ``columns`` for its %d, as format_string
    makes it, which takes most of the time of a report of many rows."""
    first, *rest = kind.split("%d")
    shown = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)
    return F.concat(F.lit(first), *chain.from_iterable((c, F.lit(t)) for c, t in zip(shown, rest, strict=True)))


def scene_of_paragraph(scenes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """I-02, J-05: (project, scene, n) of the paragraphs that a scene was made
    from; scenes (project, scene, first, last), paragraphs (project, n)."""
    return scenes.join(paragraphs, "project").where("n between first and last").select("project", "scene", "n")


def violations(project: DataFrame, characters: DataFrame, scenes: DataFrame, elements: DataFrame, structure: DataFrame) -> DataFrame:
    """Q-02 .. Q-28 as rows (project, rule, severity, path).

    project (project, title), characters (project, ord, id, name, aliases), scenes
    (project, scene, id, number, setting, location, time, has_source), elements
    (project, scene, pos, type, text, character, line, mode; line_pos too for
    lines spoken together, null where such an element has none), structure
    (project, pos, scene_id).  A table without the column project is one project.
    """
    project, characters, scenes, elements, structure = map(keyed, (project, characters, scenes, elements, structure))
    if "line_pos" not in elements.columns:
        elements = elements.withColumn("line_pos", F.lit(0))
    bad = lambda when, rule, path, level="error": F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity"), path.alias("path")))
    told = lambda df, *rules: df.select("project", F.inline(F.array_compact(F.array(*rules))))
    all_ = lambda df, *rule: told(df, bad(F.lit(True), *rule))
    both = F.col("type") == "dual_dialogue"
    part = lambda field: F.when(both, at(f"scenes[%d].elements[%d].lines[%d].{field}", "scene", "pos", "line_pos")).otherwise(at(f"scenes[%d].elements[%d].{field}", "scene", "pos"))
    spoken = F.col("type").isin("dialogue", "dual_dialogue") & ~(both & F.col("line_pos").isNull())
    holds = reduce(DataFrame.union, [df.select("project", F.lit(c).alias("c"), F.lit(s).alias("s")) for df, c, s in ((characters, True, False), (scenes, False, True))])
    holds = holds.groupBy("project").agg(F.max("c").alias("_c"), F.max("s").alias("_s"))
    none = lambda c: ~F.coalesce(c, F.lit(False))
    # the rules of a row are looked at in one pass; keys that are sought elsewhere are shuffled, not broadcast
    out = [
        told(
            project.join(met(holds), "project", "left"),
            bad(blank(F.col("title")), "title", F.lit("meta.title")),
            bad(none("_c"), "characters", F.lit("characters")),
            bad(none("_s"), "scenes", F.lit("scenes")),
        ),
        told(
            characters,
            bad(blank(F.col("id")), "character_id", at("characters[%d].id", "ord")),
            bad(blank(F.col("name")), "character_name", at("characters[%d].name", "ord")),
        ),
        told(
            scenes,
            bad(blank(F.col("id")), "scene_id", at("scenes[%d].id", "scene")),
            bad(F.col("number").isNull(), "scene_number", at("scenes[%d].number", "scene")),
            bad(~F.coalesce(F.col("setting").isin(*SETTINGS), F.lit(False)), "setting", at("scenes[%d].heading.setting", "scene")),
            bad(blank(F.col("location")), "location", at("scenes[%d].heading.location", "scene")),
            bad(~F.coalesce(F.col("time").isin(*TIMES), F.lit(False)), "time", at("scenes[%d].heading.time", "scene")),
            bad(~F.coalesce("has_source", F.lit(False)), "source", at("scenes[%d].source", "scene"), "warning"),
        ),
        all_(scenes.join(met(elements.select("project", "scene").distinct()), ["project", "scene"], "left_anti"), "empty_scene", at("scenes[%d].elements", "scene"), "warning"),
        told(
            elements,
            bad(~F.coalesce(F.col("type").isin(*ELEMENTS), F.lit(False)), "type", at("scenes[%d].elements[%d].type", "scene", "pos")),
            bad(F.col("type").isin("action", "transition") & blank(F.col("text")), "text", at("scenes[%d].elements[%d].text", "scene", "pos")),
            bad(both & F.col("line_pos").isNull(), "lines", at("scenes[%d].elements[%d].lines", "scene", "pos")),
            bad(spoken & blank(F.col("character")), "speaker", part("character")),
            bad(spoken & blank(F.col("line")), "line", part("line")),
            bad((F.col("type") == "dialogue") & F.col("mode").isNotNull() & ~F.col("mode").isin(*MODES), "mode", at("scenes[%d].elements[%d].mode", "scene", "pos")),
        ),
    ]
    w = W.partitionBy("project", "id").orderBy("ord")
    again = characters.where(~blank(F.col("id"))).withColumn("k", F.row_number().over(w))
    out.append(all_(again.where("k > 1"), "character_duplicate", at("characters[%d].id", "ord")))
    speak = elements.where(spoken & ~blank(F.col("character")))
    out.append(all_(speak.join(met(characters.select("project", F.col("id").alias("character"))), ["project", "character"], "left_anti"), "speaker_unknown", part("character")))
    out.append(all_(structure.join(met(scenes.select("project", F.col("id").alias("scene_id"))), ["project", "scene_id"], "left_anti"), "structure", at("structure[%d].scene_ids", "pos")))
    out.append(all_(speaks_early(elements, characters), "speaks_early", F.concat(F.lit("scenes["), F.col("scene").cast("string"), F.lit("] "), F.col("id")), "warning"))
    return reduce(DataFrame.unionByName, out)


def _kind(v: Column, path: str) -> Column:
    """The type of a value in a JSON text, as object, array, string, number and
    so on; null where there is none."""
    name = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return F.lower(F.regexp_extract(name, "^[A-Z]+", 0))


def shape_violations(raw: DataFrame) -> DataFrame:
    """Q-01, Q-04, Q-09, Q-12, Q-16, Q-18: (project, rule, path) for what isn't of
    the right kind in a screenplay's JSON text; raw (project, json)."""
    v = staged(raw.select("project", F.try_parse_json("json").alias("v")))
    is_ = lambda kind, path: F.coalesce(_kind(F.col("v"), path) == kind, F.lit(False))
    say = lambda df, rule, path: df.select("project", F.lit(rule).alias("rule"), path.alias("path"))
    items = lambda df, path, *keep: df.select("project", *keep, F.posexplode(F.variant_get("v", path, "array<variant>")).alias("i", "v"))
    root = v.where(is_("object", "$"))
    people = items(root.where(is_("array", "$.characters")), "$.characters")
    scenes = items(root.where(is_("array", "$.scenes")), "$.scenes").withColumnRenamed("i", "s")
    whole = scenes.where(is_("object", "$"))
    lists = whole.where(is_("array", "$.elements"))
    return reduce(
        DataFrame.unionByName,
        [
            say(v.where(~is_("object", "$")), "root", F.lit("(root)")),
            say(people.where(~is_("object", "$")), "character", F.format_string("characters[%d]", "i")),
            say(scenes.where(~is_("object", "$")), "scene", F.format_string("scenes[%d]", "s")),
            say(whole.where(~is_("object", "$.heading")), "heading", F.format_string("scenes[%d].heading", "s")),
            say(whole.where(~is_("array", "$.elements")), "elements", F.format_string("scenes[%d].elements", "s")),
            say(items(lists, "$.elements", "s").where(~is_("object", "$")), "element", F.format_string("scenes[%d].elements[%d]", "s", "i")),
        ],
    )


#: What a screenplay's JSON text holds, for ``flatten``.
SCENE = "struct<id:string,number:double,heading:struct<setting:string,location:string,time:string>,source:string,elements:array<struct<type:string,text:string,character:string,parenthetical:string,line:string,mode:string,lines:array<struct<character:string,line:string>>>>>"


def flatten(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-04: (scenes, elements) of scene texts: raw (project, ord, json), one JSON
    object {scenes: [...]} a batch.  Scenes of all batches are numbered anew in
    order; lines spoken together are one row each.  A text that can't be read
    gives no scenes.  A text is read once for both tables, behind the only shuffle."""
    texts = raw.select("project", "ord", "json").repartition("project").sortWithinPartitions("project", "ord")
    got = texts.select("project", "ord", F.from_json(json_text(F.col("json")), f"struct<scenes:array<{SCENE}>>")["scenes"].alias("x"))
    before = F.coalesce(F.sum(F.size(F.coalesce("x", F.array()))).over(W.partitionBy("project").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = got.withColumn("before", before.cast("int")).select("project", "before", F.posexplode("x").alias("p", "v"))
    one = staged(one.select("project", (F.col("before") + F.col("p") + 1).alias("scene"), "v"))
    scenes = one.select("project", "scene", padded_id("scene_", F.col("scene")).alias("id"), F.col("scene").alias("number"), "v.heading.setting", "v.heading.location", "v.heading.time", F.coalesce(F.col("v.source").startswith("{"), F.lit(False)).alias("has_source"))
    e = one.select("project", "scene", F.posexplode("v.elements").alias("pos", "e"))
    lone = F.array(F.struct(F.lit(0).alias("line_pos"), F.col("e.character").alias("character"), F.col("e.line").alias("line")))
    many = F.transform("e.lines", lambda x, i: F.struct(i.alias("line_pos"), x["character"].alias("character"), x["line"].alias("line")))
    e = e.select("project", "scene", "pos", F.col("e.type").alias("type"), F.col("e.text").alias("text"), F.col("e.mode").alias("mode"), F.col("e.parenthetical").alias("parenthetical"), F.explode_outer(F.when(F.col("e.type") == "dual_dialogue", many).otherwise(lone)).alias("l"))
    return scenes, e.select("project", "scene", "pos", "type", "text", "mode", "parenthetical", "l.line_pos", "l.character", "l.line")


def generate(project: DataFrame, characters: DataFrame, batches: DataFrame, repair) -> dict[str, DataFrame]:
    """G-04, G-05: assembles the scenes of all batches (project, ord, json), checks
    them, has those with errors repaired once by ``repair`` (rows (project, rule,
    path) of errors to rows (project, json) of new scenes) and checks again.

    What remains is returned with its violations rather than lost: status
    (project, errors, warnings, repaired, scenes), scenes, elements, violations.
    A repair that can't be read leaves the scenes as they were.  Rules hold within
    a project, so only projects with new scenes are read and checked again.
    """
    nothing = project.select("project", F.lit(0).alias("pos"), F.lit("").alias("scene_id")).where("false")
    scenes, elements = map(staged, flatten(batches))
    found = staged(violations(project, characters, scenes, elements, nothing))
    errors = met(found.where("severity = 'error'"))
    tried = staged(errors.select("project").distinct())
    fixed = repair(errors).select("project", F.lit(0).alias("ord"), "json")
    readable = F.from_json(json_text(F.col("json")), f"struct<scenes:array<{SCENE}>>")["scenes"].isNotNull()
    fixed = staged(fixed.join(met(tried), "project", "left_semi").where(readable))
    new = fixed.select("project").distinct()
    kept = lambda df: df.join(met(new), "project", "left_anti")
    mended = lambda df: df.join(met(new), "project", "left_semi")
    scenes_of, elements_of = map(staged, flatten(fixed))
    left = staged(kept(found).unionByName(violations(mended(project), mended(characters), scenes_of, elements_of, nothing)))
    scenes, elements = kept(scenes).unionByName(scenes_of), kept(elements).unionByName(elements_of)
    by = left.groupBy("project").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    size = scenes.groupBy("project").agg(F.count("*").alias("scenes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = project.select("project").join(met(by), "project", "left").join(met(tried.withColumn("repaired", F.lit(True))), "project", "left").join(met(size), "project", "left")
    status = status.select("project", zero("errors"), zero("warnings"), F.coalesce("repaired", F.lit(False)).alias("repaired"), zero("scenes"))
    return {"status": status, "scenes": scenes, "elements": elements, "violations": left}


def report_lines(found: DataFrame, most: int = 5) -> DataFrame:
    """A-16: (project, severity, n, first, more): the number of violations, the
    first ``most`` as texts and how many there are besides."""
    by = found.groupBy("project", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(": ", "path", "rule"))).alias("x"))
    return by.select("project", "severity", "n", F.slice("x", 1, most).alias("first"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def render(project: DataFrame, characters: DataFrame, scenes: DataFrame, elements: DataFrame) -> DataFrame:
    """R-01, S-08: (project, text): the fixed layout of each screenplay.

    project (project, title), characters (project, id, name), scenes (project,
    scene, number, setting, location, time), elements (project, scene, pos,
    line_pos, type, text, character, mode, parenthetical, line).
    """
    who = elements.join(characters.select("project", F.col("id").alias("character"), "name"), ["project", "character"], "left")
    name = F.coalesce("name", "character")
    mode = F.when(F.col("mode") == "voiceover", "（画外）").when(F.col("mode") == "off_screen", "（画外音）").otherwise("")
    aside = F.when(F.length("parenthetical") > 0, F.concat(F.lit("（"), F.col("parenthetical"), F.lit("）"))).otherwise("")
    line = (
        F.when(F.col("type") == "action", F.concat(F.lit("△ "), F.col("text")))
        .when(F.col("type") == "dialogue", F.concat(name, mode, aside, F.lit("："), F.col("line")))
        .when(F.col("type") == "dual_dialogue", F.concat(name, F.lit("（同时）："), F.col("line")))
        .when(F.col("type") == "transition", F.col("text"))
    )
    body = who.select("project", "scene", F.struct("pos", "line_pos", line.alias("t")).alias("x")).groupBy("project", "scene").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = F.concat(F.lit("第"), F.col("number").cast("string"), F.lit("场　"), label(F.col("time"), TIMES), F.lit("　"), label(F.col("setting"), SETTINGS), F.lit("　"), F.col("location"))
    parts = scenes.join(body, ["project", "scene"], "left").select("project", F.struct("scene", F.concat_ws("\n", F.array(head), F.transform("xs", lambda x: x["t"])).alias("t")).alias("x"))
    whole = parts.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("body"))
    return project.join(whole, "project", "left").select("project", F.concat(F.regexp_replace(F.concat_ws("\n\n", "title", "body"), r"\s+$", ""), F.lit("\n")).alias("text"))


def cast_section(characters: DataFrame) -> DataFrame:
    """G-09, P-14: (project, cast): a project's characters as JSON, in order;
    what a character lacks is left out."""
    one = F.struct("id", "name", F.when(F.size("aliases") > 0, F.col("aliases")).alias("aliases"), F.nullif(F.col("description"), F.lit("")).alias("description"))
    return keyed(characters).groupBy("project").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("c")))), lambda x: x["c"])).alias("cast"))


def scene_section(scenes: DataFrame) -> DataFrame:
    """G-09: (project, batch, section): the texts of a batch's scenes, each under
    its number; scenes (project, batch, number, text)."""
    line = F.concat(F.format_string("【%d】", F.col("number")), F.lit("\n"), "text")
    by = scenes.groupBy("project", "batch").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("t")))).alias("x"))
    return by.select("project", "batch", F.array_join(F.transform("x", lambda v: v["t"]), "\n\n").alias("section"))
