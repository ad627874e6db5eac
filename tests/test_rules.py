"""Rules against plain loops and hand-made cases: items, documents, references, spans, headers, components."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom import vocab
from factloom.operators import enrich, gates, text
from factloom.streaming.spans import close_spans, stream_spans


def files_of(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "file string, text string")


# --- items of requirement documents -------------------------------------------

DOC = """intro
## User Stories
1. Given nobody when ahead then dropped
### US-1: Late fee
1. Given a late loan when the night job runs then a fee is added
2. given short when x then y [code-derived]
10. Given a paid loan when the night job runs then nothing (Negative path) happens
### US 2
1. Given only one when asked then it stays alone
## Consolidated Requirements
- The system shall add a fee when a late loan meets the night job
- The system must send letters to borrowers every month
- The system shall enforce loan limits by rule 12
- The system shall send letters to borrowers every month
## Notes
10. Given first in the notes when read then kept
2. Given first in the notes when read then kept
"""


def test_stories_have_labels_and_can_be_joined(spark):
    sections = text.md_sections(files_of(spark, DOC)).filter("section = 'User Stories'")
    got = [(r.story, r.label, r.negative) for r in text.story_acs(sections).orderBy("pos").collect()]
    assert got == [("US-1: Late fee", "US-1-Late-fee-AC-1", False), ("US-1: Late fee", "US-1-Late-fee-AC-2", False), ("US-1: Late fee", "US-1-Late-fee-AC-10", True), ("US 2", "US-2-AC-1", False)]
    whole = [(r.label, r.text, r.negative) for r in text.story_acs(sections, aggregate=True).orderBy("pos").collect()]
    assert whole[1] == ("US-2-AC-1", "Given only one when asked then it stays alone", False)
    assert whole[0][0] == "US-1-Late-fee-aggregated" and whole[0][2] and whole[0][1].split("\n")[1:] == ["AC-2: given short when x then y", "AC-10: Given a paid loan when the night job runs then nothing (Negative path) happens"]
    bare = text.story_acs(spark.createDataFrame([("f", "User Stories", "4. Given no heading when read then general")], "file string, section string, body string"))
    assert [r.label for r in bare.collect()] == ["US-general-AC-4"]


def test_criteria_below_their_numbers_equal_a_pattern_over_the_story(spark):
    r, numbered = random.Random(8), re.compile(r"^\s*(\d+)\.\s+(.+)$", re.MULTILINE)
    line = lambda k: r.choice((f"{k}.", f"  {k}.  ", f"{k}. Given a{k} when b then c", f"Given d{k} when e then f  ", "", "  ", f"{k}. short", "plain text", f"\t{k}.\tGiven g when h{k} then i [code-derived]"))
    docs = [(f"f{k}", "User Stories", "\n".join("### US-2: two" if r.random() < 0.1 else line(j) for j in range(r.randrange(14)))) for k in range(150)]
    want = []
    for f, _, body in docs:
        cut = [m.start() for m in re.finditer(r"^### US", body, re.MULTILINE)]
        for block in [body[a:b] for a, b in zip(cut, [*cut[1:], len(body)])] or [body]:
            found = [(n, t.replace("[code-derived]", "").strip()) for n, t in numbered.findall(block)]
            want += [(f, n, t) for n, t in found if len(t) >= 10 and re.search(r"\bgiven\b.*\bwhen\b.*\bthen\b", t, re.IGNORECASE)]
    got = text.story_acs(spark.createDataFrame(docs, "file string, section string, body string"))
    assert sorted((x.file, x.label.rsplit("-", 1)[1], x.text) for x in got.collect()) == sorted(want)
    assert len(want) > 100


def test_items_keep_the_first_of_equal_texts(spark):
    got = {(r.section, r.label) for r in text.requirement_items(files_of(spark, DOC)).collect()}
    assert ("Notes", "US-general-AC-10") in got and ("Notes", "US-general-AC-2") not in got
    assert {lab for sec, lab in got if sec == "Consolidated Requirements"} == {"REQ-1", "REQ-2", "REQ-3"}  # REQ-4 says the same as REQ-2
    new = {(r.section, r.label) for r in text.requirement_items(files_of(spark, DOC), new_only=True).collect()}
    assert {lab for sec, lab in new if sec == "Consolidated Requirements"} == {"REQ-2"}
    assert {r.tier for r in text.requirement_items(files_of(spark, DOC), secondary=False).collect()} == {"primary"}


def test_similar_texts_equal_all_pairs(spark):
    r = random.Random(2)
    say = lambda: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta io x The".split()) for _ in range(r.randrange(9)))
    left, right = ([(f"f{r.randrange(3)}", k, say()) for k in range(80)] for _ in range(2))
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2}
    for least in (0.3, 0.55, 1.0):
        want = {k for f, k, a in left for g, _, b in right if f == g and words(a) and words(b) and len(words(a) & words(b)) / min(len(words(a)), len(words(b))) >= least}
        got = text.similar_texts(spark.createDataFrame(left, "file string, k int, text string"), spark.createDataFrame(right, "file string, k int, text string").drop("k"), ["k"], least)
        assert {x.k for x in got.collect()} == want


def test_profiles_look_at_unit_story_and_text(spark):
    items = spark.createDataFrame([("extract_unit", "Notes", "s", "AC-1", "plain"), ("u", "Gap Analysis", "notify them", "GAP-1", "x (negative path)")], "file string, section string, story string, label string, text string")
    got = {r.file: (r.stage, r.intent, r.actions, r.outcomes) for r in text.profile_items(items).collect()}
    assert got["extract_unit"][0] == "extract" and got["extract_unit"][2] == ["retrieve"]
    assert got["u"] == ("notify", "negative", ["notify", "route"], ["expect_notify", "expect_route", "expect_stop"])


# --- documents ----------------------------------------------------------------


def test_sections_are_appended_after_blank_lines(spark):
    r = random.Random(3)
    rows, want = [(k, -1, "open", "", "") for k in range(30)] + [(k, 1000, "finish", "", "") for k in range(30)], {}
    for n in range(200):
        k, s, t = r.randrange(30), r.choice("ab"), r.choice(("", "\n", "x", "x\n\n", "\ny", "two\nlines"))
        rows.append((k, n, "text", s, t))
        before = want.get((k, s), "")
        want[k, s] = (before + ("\n" if before else "") + t).rstrip("\n") + "\n"
    got = {(x.unit, x.section): x.body for x in text.assemble_docs(spark.createDataFrame(rows, "unit int, ord int, kind string, section string, text string")).collect()}
    assert got == want


def test_every_canonical_section_is_rendered(spark):
    docs = spark.createDataFrame([("u", None, "Job", "code-derived", True, 0.5, "3 facts"), ("v", "T", "", "human", False, None, None)], "unit string, title string, unit_type string, provenance string, requirement_backed boolean, confidence double, grounding string")
    sections = spark.createDataFrame([("u", "Extra", 0, " \n"), ("u", "2. input specification", 1, "old"), ("u", "Input Specification", 2, "\nnew\n"), ("u", "Annex", 3, "last")], "unit string, section string, pos int, body string")
    names = spark.createDataFrame([("u", 2, "b"), ("u", 1, "z")], "unit string, ord int, name string")
    got = {r.unit: r.markdown for r in text.render_docs(docs, sections, names).collect()}
    parts = "".join(f"## {k}. {s}\n\n{'new' if k == 2 else '_(none)_'}\n\n" for k, s in enumerate(vocab.SECTIONS, 1))
    assert got["u"] == (
        "# Requirement Document: u\n\n**Unit:** `u`  ·  **Type:** Job\n\n**Provenance:** code-derived  ·  **Requirement-backed:** yes  ·  **Confidence:** 0.5\n**Grounding:** 3 facts\n\n"
        + parts + "## 10. Extra\n\n_(none)_\n\n## 11. Annex\n\nlast\n\n---\n**Grounded identifiers (re-checked at the boundary):** `z`, `b`\n"
    )
    assert got["v"].startswith("# Requirement Document: T\n\n**Unit:** `v`  ·  **Type:** Unknown\n") and got["v"].count("_(none)_") == 10 and "_(not recorded)_" in got["v"]


# --- references, components, coverage -----------------------------------------


def test_references_go_hop_by_hop(spark):
    rows = [
        (1, "variable", ["x"], "dflt", True), (1, "values", ["x"], "expr()", False),  # given, but not as a literal
        (1, "variable", ["y"], "why", True), (2, "variable", ["y"], "f()", False),  # the literal default stays
        (1, "values", ["m", "a"], "old", True), (2, "values", ["m", "b"], "new", True), (1, "variable", ["m"], "root", True),
        (1, "local", ["l"], "loc", True), (1, "resource", ["aws_lambda_function", "f", "function_name"], "run", True), (1, "resource", ["aws_lambda_function", "f", "memory"], "128", True),
        (1, "resource", ["aws_sfn_state_machine", "s", "name"], "flow", True), (1, "resource", ["aws_sfn_state_machine", "s", "arn"], "typed", True), (1, "resource", ["other", "o", "arn"], "own", True),
        (1, "values", ["deep", "a.b", "c"], "dots", True),
    ]
    want = {
        "var.x": None, "var.y": "why", "var.m": None, 'var.m["a"]': None, 'var.m["b"]': "new", "var.m.b": "new", "var.m.b.c": None, "var.gone": None, "local.l": "loc", "local.l.m": None,
        "aws_lambda_function.f.arn": "run", "aws_lambda_function.f.memory": "128", "aws_lambda_function.g.arn": None, "aws_sfn_state_machine.s.arn": "flow", "other.o.arn": "own", "x": None, "": None,
        'var.deep["a.b"].c': "dots",
    }
    got = enrich.resolve_refs(spark.createDataFrame(rows, "ord int, kind string, path array<string>, value string, is_literal boolean"), spark.createDataFrame([(r,) for r in want], "ref string"))
    assert {r.ref: r.value for r in got.collect()} == want


def test_components_fall_back_in_order(spark):
    parts = [("a", "src/app", "app"), ("a", "lib/util", "util"), ("a", "", "_unassigned"), ("b", "x/y", "y"), ("b", "x/z", "z")]
    paths = {("a", "src/app2/f.py"): "app", ("a", "lib/util/f.py"): "util", ("a", "other/util/f.py"): "util", ("a", "none/here"): "_unassigned", ("a", "bare.py"): "_unassigned", ("a", None): "_unassigned", ("b", None): "z", ("b", "q"): "z", ("b", "q/y"): "y"}
    e = spark.createDataFrame([(app, f"{app}{k}", p) for k, (app, p) in enumerate(paths)], "app_id string, id string, file_path string")
    got = enrich.assign_components(e, spark.createDataFrame(parts, "app_id string, prefix string, component string"))
    assert {(r.app_id, r.file_path): r.component for r in got.collect()} == paths
    flat = spark.createDataFrame([("a", "1", "only.py", "py"), ("a", "2", "d/e.py", ""), ("a", "3", None, None)], "app_id string, id string, file_path string, language string")
    inferred = enrich.infer_components(flat, spark.createDataFrame([("a",), ("z",)], "app_id string"))
    assert {(r.app_id, r.component, tuple(r.languages), r.prefix, r.entity_count) for r in inferred.collect()} == {("a", "_unassigned", ("py",), "", 2), ("a", "e.py", (), "d/e.py", 1), ("z", "default", (), "", 0)}


def test_units_without_anything_nearby_are_covered(spark):
    items = spark.createDataFrame([(1, "u"), (2, "v")], "id int, unit string")
    got = gates.unit_traceability(items, spark.createDataFrame([(1, "g")], "id int, generated string"), spark.createDataFrame([("v", "m", False)], "unit string, manual string, covered boolean"))
    assert {r.unit: (r.pct, r.nearby_pct) for r in got.collect()} == {"u": (100.0, 100.0), "v": (0.0, 0.0)}


def test_nothing_checked_has_no_precision(spark):
    assert enrich.grade(spark.createDataFrame([(None,)], "verified boolean")).first().precision == 0.0


# --- spans --------------------------------------------------------------------


def stack_spans(rows):
    """(id -> end, status, parent) by a stack for each user."""
    out, stacks = {}, {}
    for i, user, kind, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        stack = stacks.setdefault(user, [])
        if kind == "signup":
            out[i] = [None, "unclosed", stack[-1] if stack else None]
            stack.append(i)
        elif stack and kind in ("purchase", "error"):
            out[stack.pop()][:2] = [i, "fail" if kind == "error" else "ok"]
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def nested():
    r = random.Random(5)
    return [(k, r.randrange(6), r.choice(("signup", "signup", "purchase", "error", "view")), r.randrange(400)) for k in range(400)]


def events_of(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, event_type string, at int").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(1700000000 + at) AS ts")


def test_batch_spans_nest_as_a_stack(spark, nested):
    got = {r.span_id: (r.end_id, r.status, r.parent_id) for r in close_spans(events_of(spark, nested)).collect()}
    assert got == stack_spans(nested)


def test_streamed_spans_nest_as_a_stack(spark, nested, tmp_path):
    """Three files, rows late by less than the delay; a last event far ahead lets timers end what is open."""
    late = sorted(nested, key=lambda x: x[3] + (x[0] * 37) % 50)
    parts = [late[:150], late[150:300], late[300:], [(10_000, 99, "view", 100_000), (10_001, 99, "signup", 100_000)], [(10_002, 99, "signup", 200_000)]]
    source = str(tmp_path / "in")
    schema = events_of(spark, parts[0]).schema
    for part in parts:
        events_of(spark, part).coalesce(1).write.mode("append").parquet(source)
        q = stream_spans(spark.readStream.schema(schema).parquet(source), delay="60 seconds", longest_ms=50_000_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.span_id: (r.end_id, r.status, r.parent_id) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.user_id != 99}
    assert got == stack_spans(nested)


# --- feature files ------------------------------------------------------------


def plain_features(body):
    """Scenarios as (name, tags, steps with those of the background first)."""
    shared, pending, out, now = [], [], [], None
    for raw in body.split("\n"):
        line = raw.strip()
        if not line or line[0] == "#" or line[:3] in ('"""', "'''"):
            continue
        kind = next((k for k, p in (("scenario", r"(?i)scenario(\s+outline)?:"), ("feature", "(?i)feature:"), ("background", "(?i)background:"), ("examples", "(?i)examples:$"), ("step", r"(?i)(given|when|then|and|but|\*)\s+")) if re.match(p, line)), None)
        name = line.split(":", 1)[-1].strip()
        if line[0] == "@" and now is None:
            pending += re.findall(r"^@([\w-]+)", line)
        elif kind == "scenario":
            now = (name or "Unnamed scenario", pending, [*shared])
            out.append(now)
            pending = []
        elif kind in ("feature", "background"):
            now, pending = None, []
            if kind == "background":
                shared = [("Background", name)] if name else []
        elif kind == "step":
            word, step = re.match(r"(\S+)\s+(.*)$", line).groups()
            (shared if now is None else now[2]).append(("Step" if word == "*" else word.capitalize(), step.strip()))
        elif kind != "examples":
            pending = []
    return out


def test_features_equal_a_plain_loop(spark):
    r = random.Random(8)
    menu = ["Feature: f", "Background:", "Background: base text", "Scenario: s", "scenario outline: o", "Scenario:", "@a @b", "@c-d", "Given one", "  when\ttwo", "* three", "And  four ", "Examples:", "| h | i |", "| 1 | 2 |", "prose here", "# note", "", '"""', "\tThen five"]
    bodies = ["\n".join(r.choice(menu) for _ in range(r.randrange(30))) for _ in range(120)]
    scenarios, steps = text.parse_features(files_of(spark, *bodies))
    by = {}
    for s in steps.collect():
        by.setdefault((s.file, s.at), []).append((s.pos, s.keyword, s.text))
    got = {}
    for s in scenarios.collect():
        got.setdefault(s.file, []).append((s.at, s.scenario, s.tags, [x[1:] for x in sorted(by.get((s.file, s.at), []))]))
    for k, body in enumerate(bodies):
        assert [(n, list(t), list(p)) for _, n, t, p in sorted(got.get(f"f{k}", []))] == plain_features(body)


def plain_headers(body):
    tags, pending, seen, prose, line_no, scenes = [], [], False, False, 0, []
    for n, raw in enumerate(body.split("\n"), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("@"):
            pending += [w for w in line.split() if w.startswith("@")]
        elif line.startswith("Feature:"):
            seen, line_no, tags, pending = True, n, pending, []
        elif line.startswith(("Scenario:", "Scenario Outline:")):
            scenes.append((n, line.split(":", 1)[1].strip(), pending + tags))
            pending = []
        elif seen and not scenes and not line.startswith(("Background:", "Given", "When", "Then", "And", "But", "|", "Examples:")):
            prose = True
    return line_no, tags, prose, scenes


def test_headers_equal_a_plain_loop(spark):
    r = random.Random(9)
    menu = ["Feature: f", "Feature: g", "Scenario: s", "Scenario Outline: o 1", "@a @b", "@c  x @d", "Given one", "prose", "| 1 |", "# no", "", "Background:", "scenario: lower"]
    bodies = ["\n".join(r.choice(menu) for _ in range(r.randrange(14))) for _ in range(120)]
    features, scenarios = text.scan_headers(files_of(spark, *bodies))
    head = {x.feature_file: (x.line, x.tags, x.description) for x in features.collect()}
    own = {}
    for x in scenarios.collect():
        own.setdefault(x.feature_file, []).append((x.line, x.name, x.tags))
    for k, body in enumerate(bodies):
        line, tags, prose, scenes = plain_headers(body)
        assert head[f"f{k}"] == (line, tags, prose) and sorted(own.get(f"f{k}", [])) == scenes


def test_standards_find_what_is_written(spark):
    body = "@wip @team\nFeature: f\n@slow\nScenario: US-1 login\nGiven x\nScenario: logout"
    check = lambda config: {(r.line, r.name, r.rule, r.severity, r.symbol) for r in gates.check_standards(*text.scan_headers(files_of(spark, body)), config).collect()}
    assert check({"scenario_name_must_include": ["US-", "BUG-"]}) == {(6, "logout", "scenario-name", "ERROR", None)}
    assert check({"forbidden_tags": ["@wip", "@slow"], "severity": "WARNING"}) == {(2, None, "forbidden-tag", "WARNING", "@wip"), (4, "US-1 login", "forbidden-tag", "WARNING", "@slow")}
    assert check({"required_tags": ["@team", "@slow"]}) == {(6, "logout", "required-tag", "ERROR", "@slow")}
    assert check({"max_scenarios_per_feature": 1, "require_feature_description": True}) == {(2, None, "max-scenarios", "ERROR", None), (2, None, "feature-description", "ERROR", None)}
    assert check({}) == set() == check({"severity": "WARNING"})
    for bad in ({"name_marker": "x"}, {"required_tags": "x"}, {"required_tags": [" "]}, {"max_scenarios_per_feature": True}, {"max_scenarios_per_feature": 0}, {"severity": "INFO"}, {"require_feature_description": 1}):
        with pytest.raises(ValueError):
            gates.load_standards(bad)


def test_scenarios_of_one_name_are_counted_each(spark):
    steps = [("f", 1, "same", k, w, "t") for k, w in enumerate(("Given", "When", "Then"))] + [("f", 9, "same", 10, "When", ""), ("f", 20, "late", 21, "When", "t"), ("f", 20, "late", 22, "Given", "t"), ("f", 20, "late", 23, "Then", "t")]
    df = spark.createDataFrame(steps, "feature_file string, at int, name string, pos int, keyword string, text string")
    assert [tuple(r) for r in gates.compliance(df).collect()] == [("f", 3, 2, 100.0 * 2 / 3)]
    assert sorted((r.at, r.rule, r.severity) for r in gates.compliance_findings(df).collect()) == [(9, "empty-step", "ERROR"), (9, "given-required", "ERROR"), (9, "then-required", "ERROR"), (20, "keyword-order", "WARNING")]
    assert gates.compliance(df.filter(F.lit(False))).count() == 0
