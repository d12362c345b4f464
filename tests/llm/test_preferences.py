"""Prompts, completions and masks of small pairs."""

from scholarch.llm import preferences

SCHEMA = "pair_id long, rejected boolean, turn long, role string, text string, prompt string"


def turns(*rows):
    return [(*r, "x") for r in rows]


def rendered(*turns):
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


def test_pairs(spark):
    rows = turns(
        (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "good"), (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "bad"), (1, True, 2, "user", "why"),
        (2, False, 0, "user", "a"), (2, True, 0, "user", "a"),
        (3, False, 0, "user", "a"), (3, True, 0, "user", "a"), (3, True, 1, "assistant", "b"),
        (4, False, 0, "user", "alone"),
        (5, True, None, None, None), (5, False, 7, "assistant", "<|end|> x"),
        (6, False, 0, "user", "a"), (6, False, 0, "user", "a"), (6, True, 0, "user", "a"),
        (None, False, 0, "user", "lost"), (7, None, 0, "user", "lost"),
    )
    got = {r.pair_id: r for r in preferences.format_preferences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert (got[1].status, got[1].n_prefix, got[1].prompt) == ("pair", 1, rendered(("user", "hi")))
    assert got[1].chosen == rendered(("assistant", "good"))
    assert got[1].rejected == rendered(("assistant", "bad"), ("user", "why"))
    assert [tuple(m) for m in got[1].rejected_mask] == [(False, 14), (True, 12), (False, 9), (False, 12)]
    assert got[2].status == "identical" and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == []
    assert got[3].status == "continued" and got[3].chosen == "" and got[3].rejected == rendered(("assistant", "b"))
    assert got[4].status == "single" and got[4].rejected is None and got[4].rejected_mask is None and got[4].prompt == ""
    assert got[5].status == "pair" and got[5].chosen == "<|assistant|>\n< |end|> x\n<|end|>\n" and got[5].rejected == rendered(("", ""))
    assert got[6].status == "continued" and got[6].chosen == rendered(("user", "a"))
    for r in got.values():
        for side, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert side is None or sum(m.chars for m in mask) == len(side)


def test_empty_table(spark):
    assert preferences.format_preferences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbouring_pairs_cover_every_conversation(spark):
    conv = spark.createDataFrame([(i, 0, "user", str(i)) for i in [-3, -2, 0, 1, 2, 5]], "conv_id long, turn long, role string, text string")
    got = {(r.pair_id, r.rejected): r.text for r in preferences.neighbouring_pairs(conv).collect()}
    assert got == {(-2, True): "-3", (-1, False): "-2", (0, False): "0", (0, True): "1", (1, False): "2", (2, True): "5"}


def test_other_answers(spark):
    rows = [
        (4, 0, "user", "hi"), (4, 1, "assistant", "good"), (4, 2, "user", "more"), (4, 3, "assistant", "fine"), (4, 4, "user", "bye"),
        (5, 0, "user", "ho"), (5, 1, "assistant", "other"),
        (6, None, None, None), (6, 0, "assistant", "alone"), (6, 0, "assistant", "alone"),
        (8, 0, "user", "never answered"), (9, 0, "assistant", None),
        (-1, 0, "assistant", "below"), (-2, 2, "assistant", "zero"), (None, 0, "user", "lost"),
    ]
    turns = preferences.answered_otherwise(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS last", "1 AS pair_id", "true AS rejected"))
    got = {r.pair_id: r for r in preferences.format_preferences(turns).collect()}
    assert sorted(got) == [-2, -1, 4, 5, 6, 8, 9]
    assert (got[4].n_prefix, got[4].status) == (3, "pair")
    assert got[4].prompt == rendered(("user", "hi"), ("assistant", "good"), ("user", "more"))
    assert got[4].chosen == rendered(("assistant", "fine"), ("user", "bye")) and got[4].rejected == rendered(("assistant", "other"))
    assert (got[5].n_prefix, got[5].rejected) == (1, rendered(("assistant", "good")))
    assert (got[6].n_prefix, got[6].status, got[6].rejected) == (1, "continued", "") and got[6].chosen == rendered(("assistant", "alone")) * 2
    assert (got[8].status, got[8].n_prefix) == ("identical", 1)
    assert (got[9].status, got[9].chosen, got[9].rejected) == ("single", rendered(("assistant", "")), None)
    assert (got[-1].rejected, got[-2].rejected) == (rendered(("assistant", "zero")), rendered(("assistant", "below")))


def test_most_pairs_of_the_table_share_turns(spark):
    turns = preferences.answered_otherwise(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    rows = preferences.format_preferences(turns).select("n_prefix", "status").collect()
    assert rows and sum(r.n_prefix > 0 for r in rows) > 0.9 * len(rows)
    assert sum(r.status == "pair" for r in rows) > len(rows) / 2
