"""Text to tables: lines with carried headers.  All of it is window functions over lines, keyed by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S
from ..sources.staged import stage


def lines(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, pos, line)"""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def strip(c: str | Column) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def carry_forward(df: DataFrame, header: Column, name: str, part: str = "file", order: str = "pos") -> DataFrame:
    """the latest non-null ``header`` at or before each row of its part."""
    return df.withColumn(name, F.last(header, ignorenulls=True).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def number_items(df: DataFrame, part: list[str], order: str = "pos") -> DataFrame:
    """numbers every item of a part, before any filter."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*part).orderBy(order)))


def md_sections(files: DataFrame) -> DataFrame:
    """(file, section, at, body) split at ``## `` headings; text before the first drops.

    Of equal headings the last one's body counts, at the place (``at``) of the first.
    """
    rows = carry_forward(lines(files), F.when(F.startswith("line", F.lit("## ")), F.struct(F.col("pos").alias("at"), F.trim(F.substr("line", F.lit(4))).alias("section"))), "head")
    body = rows.filter("head IS NOT NULL AND pos > head.at").groupBy("file", "head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    heads = rows.filter("head IS NOT NULL").select("file", "head").distinct().join(body.hint("merge"), ["file", "head"], "left")
    return heads.groupBy("file", F.col("head.section").alias("section")).agg(F.min("head.at").alias("at"), F.max_by(F.coalesce("body", F.lit("")), "head.at").alias("body"))


def _body_lines(sections: DataFrame) -> DataFrame:
    at = F.col("at") if "at" in sections.columns else F.lit(0)
    return sections.select("file", "section", at.alias("at"), F.posexplode(F.split("body", "\n")).alias("pos", "line"))


def item_suffix(c: str | Column) -> Column:
    """Label of an item as part of its id: other characters become dashes, none at the ends, cut to 80."""
    c = F.col(c) if isinstance(c, str) else c
    return F.left(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-]+", "-"), "^-+|-+$", ""), F.lit(80))


#: Marks an item of what must not happen.
NEGATIVE_PATH = r"(?i)negative\s*path|\(negative"
NO_STORY = "US-general"


def story_acs(sections: DataFrame, least: int = 10, aggregate: bool = False) -> DataFrame:
    """(file, section, at, pos, story, label, text, negative) of the acceptance criteria of user stories.

    A story begins at a heading such as ``### US-1: title``; what precedes the first story of
    a section drops, a section without any is one story.  Criteria are numbered
    given-when-then lines of ``least`` characters or more; the text of a bare number is the
    next line that isn't blank, even a numbered one.  With ``aggregate`` those of a story
    with several become one item.
    """
    whole = Window.partitionBy("file", "section")
    heading = F.when(F.col("line").rlike(r"(?i)^#{1,3}\s*US[-\s]?\d+"), F.struct("pos", F.trim(F.regexp_replace("line", r"^#{1,3}\s*", "")).alias("story")))
    rows = _body_lines(sections).withColumn("head", F.last(heading, ignorenulls=True).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("any", F.max(heading.isNotNull()).over(whole)).filter("head IS NOT NULL OR NOT any")
    rows = rows.withColumn("head", F.coalesce("head", F.struct(F.lit(-1).alias("pos"), F.lit(NO_STORY).alias("story"))))
    rows = _join_bare_numbers(rows.filter(F.col("line").rlike(r"\S")), Window.partitionBy("file", "section", "head").orderBy("pos"))
    text = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*\d+\.\s+", ""), r"(?i)\[code-derived\]", ""))
    rows = rows.filter(F.col("line").rlike(r"^\s*\d+\.\s+\S")).select("file", "section", "at", "pos", "head", F.regexp_extract("line", r"^\s*(\d+)\.", 1).alias("number"), text.alias("text"))
    rows = rows.filter((F.length("text") >= least) & F.col("text").rlike(r"(?i)\bgiven\b.*\bwhen\b.*\bthen\b")).withColumn("negative", F.col("text").rlike(NEGATIVE_PATH))
    if aggregate:
        every = F.sort_array(F.collect_list(F.struct("pos", "number", "text")))
        joined = F.array_join(F.transform("every", lambda x: F.concat(F.lit("AC-"), x["number"], F.lit(": "), x["text"])), "\n")
        one = F.size("every") == 1
        rows = rows.groupBy("file", "section", "at", "head").agg(every.alias("every"), F.max("negative").alias("negative"))
        label = F.concat("head.story", F.when(one, F.concat(F.lit("-AC-"), F.col("every")[0]["number"])).otherwise("-aggregated"))
        rows = rows.select("file", "section", "at", F.col("head.pos").alias("pos"), "head", label.alias("label"), F.when(one, F.col("every")[0]["text"]).otherwise(joined).alias("text"), "negative")
    else:
        rows = rows.withColumn("label", F.concat("head.story", F.lit("-AC-"), "number"))
    return rows.select("file", "section", "at", "pos", F.col("head.story").alias("story"), item_suffix("label").alias("label"), "text", "negative")


def _join_bare_numbers(rows: DataFrame, story: WindowSpec) -> DataFrame:
    """Lines of a story that aren't blank, with the next one behind a bare number and gone itself.

    In a run of bare numbers every second one is such a next line.
    """
    bare = F.col("line").rlike(r"^\s*\d+\.\s*$")
    rows = rows.withColumns({"_bare": bare, "_at": F.row_number().over(story), "_next": F.lead("line").over(story)})
    run = F.col("_at") - 1 - F.coalesce(F.max(F.when(~F.col("_bare"), F.col("_at"))).over(story.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_run", run).filter("_run % 2 = 0")
    return rows.withColumn("line", F.when(F.col("_bare"), F.concat(strip("line"), F.lit(" "), strip("_next"))).otherwise(F.col("line"))).drop("_bare", "_at", "_next", "_run")


_SHALL, _GAP = r"(?i)^\s*[-*]\s+(?:The system shall|The system must)\s+(\S.*)$", r"(?i)^\s*[-*]\s+(?:Not documented:|Missing:|Gap:)\s*(\S.*)$"


def _bullets(sections: DataFrame, pattern: str, label: str, story: str) -> DataFrame:
    rows = number_items(_body_lines(sections).filter(F.col("line").rlike(pattern)), ["file", "section"])
    text = F.trim(F.regexp_extract("line", pattern, 1))
    return rows.select("file", "section", "at", "pos", F.lit(story).alias("story"), F.concat(F.lit(label), F.col("number").cast("string")).alias("label"), text.alias("text"))


def shall_items(sections: DataFrame, stories: DataFrame | None = None, least: float = 0.55) -> DataFrame:
    """I4: bullets that begin with "The system shall" or "The system must", numbered as found.

    With ``stories`` (from ``story_acs``), those go that say again what a story of the file
    says: their words overlap by ``least`` or more, or they enforce a numbered rule.
    """
    items = _bullets(sections, _SHALL, "REQ-", "consolidated").withColumn("text", F.concat(F.lit("The system shall "), "text"))
    items = items.withColumn("negative", F.col("text").rlike(NEGATIVE_PATH))
    if stories is None:
        return items
    key = ["file", "section", "label"]
    again = similar_texts(items.select(*key, "text"), stories.select("file", "text"), key, least)
    told = stories.select("file").distinct().withColumn("_told", F.lit(True))
    kept = items.join(again.hint("merge"), key, "left_anti").join(told.hint("merge"), "file", "left")
    return kept.filter(F.col("_told").isNull() | ~F.col("text").rlike(r"(?i)\benforce\b.+\brule\s+\d+\b")).select(*items.columns)


def similar_texts(left: DataFrame, right: DataFrame, key: list[str], least: float = 0.55) -> DataFrame:
    """Keys of the rows of ``left`` whose words (of three letters or more) overlap with a text of ``right`` of the same
    file by ``least`` of the smaller set.

    A pair needs ``ceil(least * m)`` common words, m the smaller size, so the smaller set's
    ``m - ceil(least * m) + 1`` rarest words hold one of them: only these are joined with
    the words of larger sets, once from each side.
    """
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2))
    both = stage(left.select("file", F.struct(*key).alias("id"), F.lit("l").alias("side"), words.alias("words")).unionByName(right.select("file", F.lit(None).cast(left.select(F.struct(*key).alias("id")).schema["id"].dataType).alias("id"), F.lit("r").alias("side"), words.alias("words"))).filter("size(words) > 0"), "similar-sets")
    sets = stage(both.withColumn("set", F.monotonically_increasing_id()).withColumn("m", F.size("words")), "similar-sets")
    tokens = sets.select("file", "set", "side", "m", F.explode("words").alias("w"))
    tokens = tokens.withColumn("n", F.count("*").over(Window.partitionBy("file", "w"))).withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy("n", "w")))
    tokens = stage(tokens, "similar-words")
    rare = tokens.filter(F.col("place") <= F.col("m") - F.ceil(F.col("m") * least) + 1)

    def meet(small: str, large: str, fits: Column) -> DataFrame:
        a = rare.filter(F.col("side") == small).select("file", "w", F.col("set").alias(small), F.col("m").alias("m1"))
        b = tokens.filter(F.col("side") == large).select("file", "w", F.col("set").alias(large), F.col("m").alias("m2"))
        return a.join(b.hint("merge"), ["file", "w"]).filter(fits).select("l", "r")

    pairs = meet("l", "r", F.col("m1") <= F.col("m2")).unionByName(meet("r", "l", F.col("m1") < F.col("m2"))).distinct()
    one = sets.select(F.col("set").alias("l"), "id", F.col("words").alias("a"))
    two = sets.select(F.col("set").alias("r"), F.col("words").alias("b"))
    common = F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b"))
    return pairs.join(one.hint("merge"), "l").join(two.hint("merge"), "r").filter(common >= least).select("id.*").distinct()


def gap_items(sections: DataFrame) -> DataFrame:
    """Bullets that begin with "Not documented:", "Missing:" or "Gap:", numbered as found."""
    return _bullets(sections, _GAP, "GAP-", "gaps").withColumn("negative", F.col("text").rlike(NEGATIVE_PATH))


def table_items(sections: DataFrame) -> DataFrame:
    """(file, section, at, pos, number, text) of table rows as ``column=value | ...``.

    The first row of a section names the columns; empty cells, n/a and dashes drop out, as do rows that are left empty.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    rows = number_items(_body_lines(sections).filter(F.col("line").rlike(r"^\s*\|(.+)\|\s*$")).withColumn("cells", cells), ["file", "section"])
    rows = rows.withColumn("names", F.first("cells").over(Window.partitionBy("file", "section").orderBy("pos")))
    rows = rows.filter((F.col("number") > 1) & ~F.forall("cells", lambda x: x.rlike("^[-:]*$")))
    pairs = F.zip_with("names", F.slice("cells", F.lit(1), F.size("names")), lambda n, c: F.when(~F.coalesce(c, F.lit("")).isin("", "n/a", "N/A", "—") & n.isNotNull(), F.concat_ws("=", n, c)))
    rows = rows.withColumn("text", F.array_join(F.array_compact(pairs), " | ")).filter("text <> ''").drop("number")
    return number_items(rows, ["file", "section"]).select("file", "section", "at", "pos", "number", "text")


def _tiered(sections: DataFrame, aggregate: bool = False, secondary: bool = True, new_only: bool = False) -> DataFrame:
    """Items of each section by what its name calls for: (file, section, at, tier, rank, pos, story, label, text, negative)."""
    key = S.section_key("section")
    s = sections.filter(~F.trim("body").isin("", "_(none)_", "(none)")).select("*", S.section_tier("section").alias("_tier"), key.alias("_key"))
    s = s.filter("_tier <> 'metadata'")
    named = F.col("_key").isin("user stories", "consolidated requirements", "function specification", "gap analysis")
    extra = ~named & (F.col("_tier") == "secondary") & F.lit(secondary)
    own = lambda name, more=extra: s.filter((F.col("_key") == name) | more)

    def ranked(items: DataFrame, tier: str, rank: int) -> DataFrame:
        return items.select("file", "section", "at", F.lit(tier).alias("tier"), F.lit(rank).alias("rank"), "pos", "story", "label", "text", "negative")

    stories = story_acs(own("user stories"), aggregate=aggregate)
    shall = shall_items(own("consolidated requirements", extra if not new_only else F.lit(False)), story_acs(own("user stories", F.lit(False))) if new_only else None)
    out = ranked(stories, "primary", 1).unionByName(ranked(shall, "primary", 2))
    if new_only:
        out = out.unionByName(ranked(shall_items(s.filter(extra)), "primary", 2))
    if not secondary:
        return out
    calls = table_items(own("function specification", F.lit(False))).filter(F.startswith(F.lower("text"), F.lit("function=")))
    calls = calls.withColumns({"story": F.lit("functions"), "label": F.concat(F.lit("FN-"), F.col("number").cast("string")), "negative": F.col("text").rlike(NEGATIVE_PATH)})
    return out.unionByName(ranked(calls, "secondary", 3)).unionByName(ranked(gap_items(own("gap analysis")), "secondary", 4))


def requirement_items(files: DataFrame, **options) -> DataFrame:
    """Items of all sections of Markdown ``files(file, text)``; ``options`` as in ``section_items``."""
    return section_items(md_sections(files), **options)


def section_items(sections: DataFrame, aggregate: bool = False, secondary: bool = True, new_only: bool = False) -> DataFrame:
    """(file, section, tier, story, label, text, negative) of ``sections(file, section, at, body)``.

    Of equal texts of a file the first in the document stays: by place of the section
    (``at``), kind and line.  ``aggregate``: one item a story; ``secondary=False``: only
    stories and requirements; ``new_only``: no requirements that stories say already.

    A file without primary items gives its gaps as ``fallback`` items; where one is there as
    a secondary item already, that stays.
    """
    first = F.min(F.struct("at", "section", "rank", "pos", "tier", "story", "label", "text", "negative")).alias("x")
    return _tiered(sections, aggregate, secondary, new_only).withColumn("hash", S.text_hash("text")).groupBy("file", "hash").agg(first).select("file", "x.section", "x.tier", "x.story", "x.label", "x.text", "x.negative")


def extraction_report(sections: DataFrame) -> DataFrame:
    """(file, primary, secondary, fallback, skipped): items found by tier, and sections of metadata passed over.

    Gaps count again as fallback where a file has no primary item.
    """
    n = lambda tier: F.count_if(F.col("tier") == tier)
    gap = F.count_if((F.col("tier") == "secondary") & (S.section_key("section") == "gap analysis"))
    found = _tiered(sections).groupBy("file").agg(n("primary").alias("primary"), n("secondary").alias("secondary"), gap.alias("gaps"))
    skipped = sections.filter(~F.trim("body").isin("", "_(none)_", "(none)")).groupBy("file").agg(F.count_if(S.section_tier("section") == "metadata").alias("skipped"))
    out = sections.select("file").distinct().join(found.hint("merge"), "file", "left").join(skipped.hint("merge"), "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select("file", zero("primary").alias("primary"), zero("secondary").alias("secondary"), F.when(zero("primary") == 0, zero("gaps")).otherwise(0).alias("fallback"), zero("skipped").alias("skipped"))


def profile_items(items: DataFrame, unit: str = "file") -> DataFrame:
    """I8: item_id, stage, intent, actions and outcomes of each item.

    Stage and actions go by the unit's name, the story and the text; the intent of an item
    that isn't marked as a negative path by its whole id.
    """
    name, corpus = F.col(unit).cast("string"), F.concat_ws(" ", F.col(unit).cast("string"), "story", "text")
    out = items.withColumn("item_id", F.concat_ws("::", name, "section", "label")).withColumns({"stage": S.stage([corpus]), "actions": S.detect(corpus)})
    out = out.withColumn("intent", F.when(F.col("text").rlike(NEGATIVE_PATH), "negative").otherwise(S.intent("item_id")))
    more = F.array_compact(F.array(F.when(F.col("intent") == "negative", "expect_stop"), F.when(F.array_contains("actions", "notify"), "expect_notify")))
    return out.withColumn("outcomes", F.sort_array(F.array_distinct(F.concat(F.transform("actions", lambda a: F.concat(F.lit("expect_"), a)), more))))


_STEP = r"(?i)^(Given|When|Then|And|But|\*)\s+(.*)$"
_SCENARIO, _BACKGROUND, _FEATURE, _EXAMPLES = r"(?i)^Scenario(\s+Outline)?:", "(?i)^Background:", "(?i)^Feature:", "(?i)^Examples:$"


def parse_features(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scenarios(file, feature, scenario, at, outline, tags, examples) and steps(file, at, pos, keyword, text, background).

    A step below a scenario is its own.  All others, be they below a Background, below a
    Feature or ahead of any heading, are background of every later scenario until the next
    Background begins; its heading's text is the first of them.  Comments and docstring
    fences are skipped; ``*`` is the keyword Step.  Tags are the first of each tag line
    above the first scenario of a feature or background; ``examples`` are the rows of a
    scenario's Examples tables, the header first.
    """
    t = F.col("t")
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ln = lines(files.repartition(width, "file")).withColumn("t", strip("line")).filter((t != "") & ~t.rlike("^(#|\"\"\"|''')"))
    title = strip(F.regexp_replace(t, "^[^:]+:", ""))
    ln = ln.withColumn("kind", F.when(F.contains(t, F.lit(":")), F.when(t.rlike(_SCENARIO), "scenario").when(t.rlike(_BACKGROUND), "background").when(t.rlike(_FEATURE), "feature")))
    kind = F.col("kind")
    head = F.when(kind.isNotNull(), F.struct(F.col("pos").alias("at"), kind.alias("kind"), title.alias("name"), t.rlike(r"(?i)outline").alias("outline")))
    rows = carry_forward(carry_forward(ln, F.when(kind == "feature", title), "feature"), head, "head")
    rows = carry_forward(rows, F.when(kind == "background", F.col("pos")), "since").withColumn("since", F.coalesce("since", F.lit(-1)))
    mine = F.coalesce(F.col("head.kind") == "scenario", F.lit(False))
    word = F.regexp_extract(t, _STEP, 1)
    steps = rows.filter(t.rlike(_STEP)).select("file", "pos", "since", mine.alias("mine"), F.col("head.at").alias("at"), F.when(word == "*", "Step").otherwise(F.initcap(word)).alias("keyword"), strip(F.regexp_extract(t, _STEP, 2)).alias("text"))
    named = rows.filter((kind == "background") & (title != "")).select("file", "pos", "since", F.lit(False).alias("mine"), F.col("pos").alias("at"), F.lit("Background").alias("keyword"), title.alias("text"))
    block = F.when(t.rlike(_EXAMPLES), F.lit(True)).when(~F.startswith(t, F.lit("|")), F.lit(False))
    cells = F.transform(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    # a tag counts if no scenario is open before it and only tags, steps and Examples headings lie between it and the next one
    scene, tagged, own = F.coalesce(kind == "scenario", F.lit(False)), F.startswith(t, F.lit("@")), Window.partitionBy("file").orderBy("pos")
    broken = F.last(F.when(~scene & ~tagged & ~t.rlike(_STEP) & ~t.rlike(_EXAMPLES), F.col("pos")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    every = carry_forward(rows, block, "in_examples").withColumns({"broken": broken, "scene": scene, "tagged": tagged & ~mine, "shown": F.coalesce(F.col("in_examples") & F.startswith(t, F.lit("|")) & mine, F.lit(False))}).filter("scene OR tagged OR shown")
    ahead = F.min(F.when(F.col("scene"), F.col("pos"))).over(own.rowsBetween(0, Window.unboundedFollowing))
    # a scenario with its tags and Examples rows is one group; of tags the group's scenario has the last break before it
    every = every.withColumn("at", F.when(F.col("scene"), F.col("pos")).when(F.col("tagged"), ahead).otherwise(F.col("head.at"))).filter("at IS NOT NULL")
    scenario = F.struct("feature", F.coalesce(F.nullif(title, F.lit("")), F.lit("Unnamed scenario")).alias("scenario"), F.col("head.outline").alias("outline"), "since", F.col("broken").alias("after"))
    marks = F.collect_list(F.when(F.col("tagged"), F.struct("pos", F.regexp_extract(t, r"^@([\w-]+)", 1).alias("tag"))))
    table = F.collect_list(F.when(F.col("shown"), F.struct("pos", cells.alias("cells"))))
    found = every.groupBy("file", "at").agg(F.max(F.when(F.col("scene"), scenario)).alias("s"), marks.alias("marks"), table.alias("table"))
    kept = F.filter(F.sort_array("marks"), lambda x: (x["tag"] != "") & (F.col("s.after").isNull() | (x["pos"] > F.col("s.after"))))
    told = F.filter(F.sort_array("table"), lambda x: ~F.forall(x["cells"], lambda c: c.rlike("^[-:]*$")))
    scenarios = found.select("file", "s.feature", "s.scenario", "at", "s.outline", "s.since", F.transform(kept, lambda x: x["tag"]).alias("tags"), F.transform(told, lambda x: x["cells"]).alias("examples"))
    shared = steps.filter(~F.col("mine")).unionByName(named).select("file", "since", F.col("pos").alias("bpos"), "keyword", "text")
    before = scenarios.select("file", "at", "since").join(shared.hint("merge"), ["file", "since"]).filter("bpos < at").select("file", "at", F.col("bpos").alias("pos"), "keyword", "text", F.lit(True).alias("background"))
    mine = steps.filter("mine").select("file", "at", "pos", "keyword", "text", F.lit(False).alias("background"))
    return scenarios.select("file", "feature", "scenario", "at", "outline", "tags", "examples"), mine.unionByName(before)


def scan_headers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """features(feature_file, line, tags, description) and scenarios(feature_file, line, name, tags) of ``files(file, text)``.

    What team rules look at: all ``@`` words of the lines between two headings belong to the
    second one; a scenario also has the tags of the latest Feature above it.  A file is
    described if prose stands between its first Feature and its first scenario.  Of several
    Features the last one's line and tags count.  Lines count from 1.
    """
    t = F.col("t")
    rows = lines(files).withColumn("t", strip("line")).filter((t != "") & ~F.startswith(t, F.lit("#")))
    tagged = F.startswith(t, F.lit("@"))
    kind = F.when(tagged, "tag").when(F.startswith(t, F.lit("Feature:")), "feature").when(t.rlike("^Scenario( Outline)?:"), "scenario").otherwise("other")
    rows = rows.withColumn("kind", kind)
    own = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind").isin("feature", "scenario")
    rows = rows.withColumns({"heads": F.count_if(heading).over(own), "features": F.count_if(F.col("kind") == "feature").over(own), "scenes": F.count_if(F.col("kind") == "scenario").over(own)})
    words = F.filter(F.split(t, r"\s+"), lambda w: F.startswith(w, F.lit("@")))
    tags = rows.filter("kind = 'tag'").groupBy("file", (F.col("heads") + 1).alias("heads")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", words.alias("w")))), lambda x: x["w"])).alias("tags"))
    none = F.array().cast("array<string>")
    heads = rows.filter(heading).join(tags.hint("merge"), ["file", "heads"], "left").withColumn("tags", F.coalesce("tags", none))
    of_feature = F.coalesce(F.last(F.when(F.col("kind") == "feature", F.col("tags")), ignorenulls=True).over(own), none)
    scenarios = heads.withColumn("all", F.concat("tags", of_feature)).filter("kind = 'scenario'").select(F.col("file").alias("feature_file"), (F.col("pos") + 1).alias("line"), strip(F.regexp_replace(t, "^[^:]+:", "")).alias("name"), F.col("all").alias("tags"))
    prose = ~t.rlike(r"^(Background:|Given|When|Then|And|But|\||Examples:)") & (F.col("kind") == "other") & (F.col("features") > 0) & (F.col("scenes") == 0)
    described = rows.groupBy("file").agg(F.max(prose).alias("description"))
    last = heads.filter("kind = 'feature'").groupBy("file").agg(F.max("pos").alias("pos"), F.max_by("tags", "pos").alias("tags"))
    features = files.select("file").distinct().join(described.hint("merge"), "file", "left").join(last.hint("merge"), "file", "left")
    return features.select(F.col("file").alias("feature_file"), F.coalesce(F.col("pos") + 1, F.lit(0)).alias("line"), F.coalesce("tags", none).alias("tags"), F.coalesce("description", F.lit(False)).alias("description")), scenarios


def added_lines(files: DataFrame) -> DataFrame:
    """(file, target, line) of the lines that unified diffs add, with their new numbers."""
    ln = lines(files)
    ln = carry_forward(ln, F.when(F.startswith("line", F.lit("+++ ")), F.regexp_replace(F.regexp_replace("line", r"^\+\+\+ ", ""), "^b/", "")), "target")
    ln = carry_forward(ln, F.when(F.startswith("line", F.lit("@@")), F.struct(F.col("pos").alias("at"), F.regexp_extract("line", r"\+(\d+)", 1).cast("int").alias("first"))), "hunk")
    body = ln.filter("hunk IS NOT NULL AND pos > hunk.at AND NOT startswith(line, '+++ ') AND NOT startswith(line, '--- ') AND NOT startswith(line, 'diff ')")
    kept = F.sum(F.when(~F.startswith("line", F.lit("-")), 1).otherwise(0)).over(Window.partitionBy("file", "hunk.at").orderBy("pos"))
    return body.withColumn("n", F.col("hunk.first") + kept - 1).filter(F.startswith("line", F.lit("+"))).select("file", "target", F.col("n").cast("int").alias("line"))


def primary_file(added: DataFrame) -> DataFrame:
    """the target with most added lines, by name on a tie."""
    return added.groupBy("file", "target").agg(F.count("*").alias("n")).groupBy("file").agg(F.min_by("target", F.struct(-F.col("n"), "target")).alias("primary"))


def harvest_env(configs: DataFrame) -> DataFrame:
    """(file, token, value) of the scalars without ``${`` in ``configs(file, environment map)``."""
    return configs.select("file", F.explode("environment").alias("token", "value")).filter("value IS NOT NULL").filter(~S.has_token("value"))


#: Folders that hold other people's code.
VENDOR = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build")


def search_source(src: DataFrame, pattern: str, limit: int = 50, glob: str | None = None, skip: tuple[str, ...] = VENDOR) -> DataFrame:
    """(file, pos, line cut to 200) that match; an invalid pattern is taken literally.

    ``glob`` is matched against the file's own name; files below a folder in ``skip`` stay out.
    """
    import fnmatch
    import re

    try:
        re.compile(pattern)
        hit = F.col("line").rlike(pattern)
    except re.error:
        hit = F.contains("line", F.lit(pattern))
    parts = F.split(F.col("file").cast("string"), "/")
    if glob is not None:
        hit = hit & F.element_at(parts, -1).rlike(fnmatch.translate(glob).replace("\\Z", "$"))
    if skip:
        hit = hit & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(s) for s in skip]))
    return src.filter(hit).select("file", "pos", F.left("line", F.lit(200)).alias("line")).orderBy("file", "pos").limit(limit)


def render_docs(docs: DataFrame, sections: DataFrame, grounded: DataFrame | None = None, order: tuple[str, ...] = vocab.SECTIONS) -> DataFrame:
    """(unit, markdown) of ``docs(unit, title, unit_type, provenance, requirement_backed, confidence, grounding)``.

    The sections of ``order`` come first, numbered, whether ``sections(unit, section, pos, body)``
    has them or not, then the others by their first place; names are compared by
    ``section_key`` and of equal ones the last counts.  Sections that are absent or blank say
    so.  The footer names the identifiers of ``grounded(unit, ord, name)``.  Confidence has
    at most six places.
    """
    none = "_(none)_"
    key = S.section_key("section")
    own = sections.withColumn("key", key).groupBy("unit", "key").agg(F.min("pos").alias("pos"), F.max_by(F.struct(strip("section").alias("section"), strip("body").alias("body")), "pos").alias("x"))
    own = own.select("unit", "key", "pos", "x.section", F.col("x.body").alias("body"))
    canon = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("section")) for n, s in enumerate(order, 1)])
    fixed = docs.select("unit", F.explode(canon).alias("c")).select("unit", "c.n", "c.section").withColumn("key", key)
    fixed = fixed.join(own.select("unit", "key", "body").hint("merge"), ["unit", "key"], "left").select("unit", "n", "section", "body")
    names = F.array(*[S.section_key(F.lit(s)) for s in order])
    extra = own.filter(~F.array_contains(names, F.col("key"))).withColumn("n", F.row_number().over(Window.partitionBy("unit").orderBy("pos", "key")) + len(order)).select("unit", "n", "section", "body")
    text = F.coalesce(F.nullif("body", F.lit("")), F.lit(none))
    part = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), "section", F.lit("\n\n"), text, F.lit("\n\n"))
    body = fixed.unionByName(extra).groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", part.alias("t")))), lambda x: x["t"]), "").alias("body"))
    out = docs.join(body.hint("merge"), "unit")
    footer = F.lit(none)
    if grounded is not None:
        marked = grounded.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: F.concat(F.lit("`"), x["name"], F.lit("`"))), ", ").alias("names"))
        out, footer = out.join(marked.hint("merge"), "unit", "left"), F.coalesce("names", F.lit(none))
    said = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    sure = F.when(F.col("confidence").isNull(), "n/a (code-derived)").otherwise(F.regexp_replace(F.format_string("%.6f", F.col("confidence").cast("double")), r"\.?0+$", ""))
    # The wording of a published document.
    head = F.concat(
        F.lit("# Requirement Document: "), said("title", F.col("unit")), F.lit("\n\n**Unit:** `"), "unit", F.lit("`  ·  **Type:** "), said("unit_type", F.lit("Unknown")),
        F.lit("\n\n**Provenance:** "), "provenance", F.lit("  ·  **Requirement-backed:** "), F.when(F.col("requirement_backed"), "yes").otherwise("no"), F.lit("  ·  **Confidence:** "), sure,
        F.lit("\n**Grounding:** "), said("grounding", F.lit("_(not recorded)_")), F.lit("\n\n"),
    )
    return out.select("unit", F.concat(head, "body", F.lit("---\n**Grounded identifiers (re-checked at the boundary):** "), footer, F.lit("\n")).alias("markdown"))


def assemble_docs(emits: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """(unit, section, body, confirmed) from ``emits(unit, ord, kind open/text/finish, section, text)``: a re-opened unit starts anew, only finished ones count.

    Texts of a section follow each other after a blank line, each without its closing line
    breaks; the section ends with one.  Later blank texts add nothing.

    With ``feedback(id)``, a text whose ``feedback_id`` is none of these is refused, and a
    section with one that is counts as confirmed by a person.
    """
    real = F.lit(None).cast("boolean")
    if feedback is not None:
        emits = emits.join(feedback.select(F.col("id").alias("feedback_id"), F.lit(True).alias("_real")).distinct().hint("merge"), "feedback_id", "left")
        emits, real = emits.filter(F.col("feedback_id").isNull() | F.col("_real")), F.col("_real")
    opened = carry_forward(emits, F.when(F.col("kind") == "open", F.col("ord")), "opened", "unit", "ord")
    last = emits.filter("kind = 'open'").groupBy("unit").agg(F.max("ord").alias("opened"))
    done = opened.filter("kind = 'finish'").select("unit", "opened").distinct()
    own = opened.filter("kind = 'text'").join(last, ["unit", "opened"], "left_semi").join(done, ["unit", "opened"], "left_semi")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.rtrim(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")))), lambda x: x["text"])
    body = F.concat(F.array_join(F.filter(texts, lambda x, k: (k == 0) | (x != "")), "\n\n"), F.lit("\n"))
    return own.groupBy("unit", "section").agg(body.alias("body"), F.coalesce(F.bool_or(real), F.lit(False)).alias("confirmed"))
