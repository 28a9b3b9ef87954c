"""The envelope of a translation call."""

import json

from textloom.operators import prompts

KIND = "format string, source string, target string, texts array<string>, context array<string>, candidates array<string>"


def made(spark, *calls, wording=prompts.Wording()):
    full = [(f, s, t, x, c, k) for f, s, t, x, c, k in calls]
    return prompts.envelopes(spark.createDataFrame(full, KIND), wording).collect()


def test_texts_stay_out_of_system_and_context(spark):
    one, two = made(spark, ("docx", "en", "zh-CN", ["First paragraph"], None, None), ("docx", "en", "zh-CN", ["Quite another"], None, None))
    assert one.system == two.system == prompts.Wording().system and one.task_context == two.task_context and one.payload != two.payload
    assert "First paragraph" not in one.system + one.task_context


def test_the_payload_is_indexed_and_the_context_whole(spark):
    (row,) = made(spark, ("md", None, "ja", ["alpha", "be\"ta\n"], None, None))
    assert json.loads(row.payload) == {"segments": [{"index": 0, "text": "alpha"}, {"index": 1, "text": 'be"ta\n'}]}
    assert json.loads(row.task_context) == {
        "format": "md", "format_constraints": list(prompts.Wording().constraints["md"]), "prompt_version": prompts.Wording().version,
        "source_language": "auto", "source_language_label": "automatically identified language", "target_language": "ja", "target_language_label": "Japanese",
    }


def test_snippets_are_context_and_at_most_five(spark):
    (row,) = made(spark, ("md", "en", "zh-CN", ["Read the guide"], ["title: setup", "  ", None, *"abcdef"], None))
    assert json.loads(row.task_context)["read_only_context"] == ["title: setup", *"abcd"]
    assert json.loads(row.payload) == {"segments": [{"index": 0, "text": "Read the guide"}]}


def test_candidates_go_by_index_or_are_refused(spark):
    good, bad, none = made(
        spark,
        ("docx_repair", "en", "zh-CN", ["<span>Receipt</span>"], None, ["<span>x"]),
        ("docx_repair", "en", "zh-CN", ["first", "second"], None, ["only one"]),
        ("html", "", "xx", [], [], []),
    )
    assert json.loads(good.payload) == {"segments": [{"index": 0, "text": "<span>Receipt</span>", "candidate": "<span>x"}]} and good.problem is None
    assert "read_only_context" not in good.task_context
    assert bad.payload is None and bad.problem == "candidate_count"
    assert json.loads(none.payload) == {"segments": []} and set(json.loads(none.task_context)) == {
        "format", "prompt_version", "source_language", "source_language_label", "target_language", "target_language_label"
    }


def test_a_second_try_keeps_the_rules_and_says_why(spark):
    first, second = made(spark, ("docx", "en", "zh-TW", ["a"], None, None), ("docx_quality_retry", "en", "zh-TW", ["a"], None, None))
    a, b = json.loads(first.task_context), json.loads(second.task_context)
    assert a["format_constraints"] == b["format_constraints"] and a["format_example"] == b["format_example"] == prompts.Wording().examples["docx", "zh"]
    assert b["retry_reason"] == prompts.Wording().retry and "retry_reason" not in a
    own = prompts.Wording(constraints={}, examples={})
    (bare,) = made(spark, ("docx", "en", "ko", ["a"], None, None), wording=own)
    assert "format_example" not in bare.task_context and "format_constraints" not in bare.task_context
