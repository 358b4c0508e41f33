"""Scalar functions and scores."""

import json

from pyspark.sql import functions as F

from evalloom.functions import scores, text, values


def one(spark, column, **cols):
    return spark.range(1).select(column).first()[0]


def test_text(spark):
    lit = F.lit
    cases = [
        (text.redact(lit("mail a.b@c.org from 10.0.0.1")), "mail <email> from <ip_address>"),
        (text.normalize_answer(lit("The  Cat's, an  APPLE!")), "cats apple"),
        (text.last_integer(lit(r"so 12 then \boxed{7} or 9")), "7"),
        (text.last_integer(lit("a 3 b 41 c")), "41"),
        (text.last_integer(lit("none")), None),
        (text.last_line(lit("a\n b \n\n ")), "b"),
        (text.normalize_label(lit("`Office - Suite`")), "office_suite"),
        (text.first_label(lit("it is security or Browser"), ["browser", "security"]), "browser"),
        (text.first_label(lit("nothing\nMy Label"), ["browser"]), "my_label"),
        (text.marked_field(lit("x [[ ## a ## ]] yes\n[[ ## b ## ]] no"), "a"), "yes"),
        (text.marked_field(lit(" whole "), "a"), "whole"),
        (text.strip_fences(lit("```json\n{}\n```")), "{}"),
        (text.clip(lit("abcdef"), 4), "abcd[2 chars truncated]"),
        (text.clip(lit("abcd"), 4), "abcd"),
        (text.pattern_key(lit("Use --the Tool!")), "use the tool"),
        (text.clean_query(lit('"a" AND b OR NOT c')), "a b c"),
        (text.classify_tool_error(lit("Request timed out: invalid")), "timeout"),
        (text.classify_tool_error(lit("Missing field")), "invalid_args"),
        (text.classify_tool_error(lit("?")), "other"),
        (text.base36(lit(1295)), "zz"),
        (text.canonical_json(lit('{"b": 1, "a": {"d": 2, "c": 3}}')), '{"a":{"c":3,"d":2},"b":1}'),
        (text.canonical_json(lit('{"a": 1, "a": 2}')), None),
        (text.is_retrieval_step(lit("FetchPage")), True),
        (text.has_greeting_or_signature(lit("Hello Ann,\nx")), True),
        (text.has_greeting_or_signature(lit("say hello")), False),
        (text.occurs_as_word(lit("use C++ (fast)"), lit("C++")), True),
        (text.occurs_as_word(lit("pre-ann"), lit("ann")), False),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]


def test_ngrams_of_short_texts_are_empty(spark):
    got = spark.range(1).select(text.ngrams(text.words(F.lit("one two three"))), text.ngrams(text.words(F.lit("a b c d e f g h i a b c d e f g h")))).first()
    assert got[0] == [] and len(got[1]) == 9


def test_scores(spark):
    def arr(*xs):
        return F.array(*map(F.lit, xs)).cast("array<string>")

    cases = [
        (scores.token_f1(arr("a", "a", "b"), arr("a", "c")), 40.0),
        (scores.token_f1(arr(), arr()), 0.0),
        (scores.tool_selection(arr(), arr()), 100.0),
        (scores.tool_selection(arr("x"), arr()), 30.0),
        (scores.tool_selection(arr("add"), arr("add", "echo")), 35.0),
        (scores.tool_selection(arr("no"), arr("add")), 0.0),
        (scores.call_ordering(arr("b", "a", "c", "b"), arr("a", "b")), 100.0),
        (scores.call_ordering(arr("b", "a"), arr("a", "b")), 50.0),
        (scores.call_ordering(arr(), arr("a")), 100.0),
        (scores.non_redundancy(F.lit(2), F.lit(1)), 45.0),
        (scores.non_redundancy(F.lit(9), F.lit(0)), 0.0),
        (scores.retrieval_overlap(F.lit("capital of France"), F.lit("the capital is Paris")), 1 / 3),
        (scores.retrieval_overlap(F.lit(None).cast("string"), F.lit("x")), 1.0),
        (scores.retrieval_overlap(F.lit("q"), F.lit("  ")), 0.0),
        (scores.retrieval_tier(F.lit(0.4)), "hit"),
        (scores.retrieval_tier(F.lit(0.39)), "partial"),
        (scores.run_status(F.lit(3), F.lit(3)), "completed"),
        (scores.run_status(F.lit(3), F.lit(1)), "degraded"),
        (scores.run_status(F.lit(3), F.lit(0)), "failed"),
        (scores.severity_weight(F.lit("odd")), 1.0),
        (scores.severity_weight(F.lit(None).cast("string")), 2.0),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]


def test_values(spark):
    deep = json.dumps({"a": {"b": {"c": {"d": {"e": 1}}}}, "l": list(range(25)), "s": "x" * 600, "j": '{"k": 1}'})
    df = spark.createDataFrame([(deep, '{"n": "${m}", "m": "v", "z": ""}')], "j string, c string")
    got = df.select(
        values.compact_json("j"), values.nested_keys("j"), values.string_leaves("c"), values.fill_placeholders(F.lit("a ${n} ${z}${q}"), "c")
    ).first()
    compact = json.loads(got[0])
    # The text itself is JSON, which counts as one level.
    assert compact["a"]["b"]["c"] == {"d": "<nested>"} or compact["a"]["b"]["c"] == "<nested>"
    assert compact["j"] == {"k": 1} and len(compact["l"]) == 20 and compact["s"] == "x" * 497 + "..."
    assert got[1] == ["a", "b", "c", "d", "e", "j", "l", "s"]
    assert got[2] == ["${m}", "v", ""]
    assert got[3]["text"] == "a v " and got[3]["missing"] == ["z", "q"]


def test_placeholders_that_hold_themselves_end():
    filled, _ = values.fill("${a}", {"a": "x${a}"}, bound=5)
    assert filled == "xxxxx${a}"


def test_key_rules_hold_at_every_depth(spark):
    raw = json.dumps({"Status": {"x": 1, "secret": 2}, "other": {"deep": {"status_code": 3, "y": 4}}, "list": [{"z": 1}, {"status": 5}], "text": "plain"})
    view = values.Compactor("status", ("SECRET",))
    assert view(raw) == {"Status": {"x": 1}, "other": {"deep": {"status_code": 3}}, "list": [{"status": 5}]}
    assert view("top level text") == "top level text" and view("[1, {\"q\": 1}]") == [1, {}]
    got = spark.range(1).select(values.compact_result("status", ("secret",))(F.lit(raw))).first()[0]
    assert json.loads(got) == view(raw)


def test_prompts(spark):
    template = "System: be ${tone}\nUser: ${q}\n\nAssistant: ${answer}"
    got = spark.range(1).select(values.render_prompt(F.lit(template), F.lit('{"tone": "kind", "q": "why?"}')).alias("p")).first()["p"]
    assert (got["prompt"], got["system"], got["user"], got["missing"]) == ("be kind\n\nwhy?", "be kind", "why?", ["answer"])
    assert values.render("just ${x} ", {"x": "text"}) == ("just text", None, "just text", [])
