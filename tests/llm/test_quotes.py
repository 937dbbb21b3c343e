import pyarrow as pa
import pytest

from courtside.llm import quotes

from .conftest import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there!\nHow are you?"),
    (1, 1, "assistant", "> hello   THERE\n\nFine, thanks."),
    (1, 2, "user", ">> Hello there!\n>> how are you\n> Fine thanks\nGood. Next?"),
    (1, 3, "assistant", "Unrelated."),
    (1, 4, "user", "> Next"),
    (2, 0, "user", "> How are you?\nquoting another conversation"),
    (2, 1, None, " > \n>> !!!\nnothing said"),
    (2, 2, "user", None),
    (2, 3, "user", "> quoting another\n> conversation\r\nyes"),
    (2, 3, "user", "> quoting another\n> conversation\r\nyes"),
    (2, 4, "user", ""),
    (3, None, "user", "> Hello there!"),
    (None, 7, "user", "> Hello there!"),
    (4, 1, "user", "x\n" * 3000 + "> x\ny"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def arrow(rows):
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()),
                     "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string())})


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_same_as_sql(llm_spark, oracle, rows):
    got = rows_of(quotes.conversations(frame(llm_spark, rows)))
    assert got == oracle(quotes.SQL, conversations=arrow(rows))
    assert len(got) == len(rows)


def test_worked_thread(llm_spark):
    out = {(r.conv_id, r.turn): r for r in quotes.conversations(frame(llm_spark, ROWS)).collect()}
    a = out[1, 1]
    assert (a.reply_to, a.n_quotes, a.n_linked, a.content) == (0, 1, 1, "Fine, thanks.")
    b = out[1, 2]  # the level-one passage is turn 1's; the level-two one is the whole of turn 0
    assert (b.reply_to, b.thread_turn, b.n_quotes, b.n_linked, b.content) == (1, 0, 2, 2, "Good. Next?")
    assert (out[1, 4].reply_to, out[1, 4].content) == (None, "")  # 'Next' is part of a line only
    assert out[1, 3].position == 3 and out[1, 4].position == 4
    c = out[2, 0]  # said in another conversation: linked, no reply
    assert (c.reply_to, c.n_linked, c.content) == (None, 1, "quoting another conversation")
    assert out[2, 3].reply_to == 0 and out[2, 3].content == "yes"
    assert out[3, None].position is None and out[3, None].reply_to is None


def test_reply_order_moves_threads_together(llm_spark):
    rows = [(1, 0, "u", "first topic"), (1, 1, "u", "second topic"), (1, 2, "u", "> first topic\nre first"),
            (1, 3, "u", "> re first\ndeeper"), (1, 4, "u", "> second topic\nre second")]
    out = quotes.conversations(frame(llm_spark, rows)).orderBy("position").collect()
    assert [r.turn for r in out] == [0, 2, 3, 1, 4]
    text = quotes.transcripts(quotes.conversations(frame(llm_spark, rows)), 3).orderBy("chunk").collect()
    assert [t.messages for t in text] == [3, 2] and ">" not in text[0].transcript.replace("|>", "")
    assert text[0].transcript == "<|u|>\nfirst topic\n<|u|>\nre first\n<|u|>\ndeeper\n"


def test_long_conversation_positions(llm_spark, oracle):
    rows = [(9, t, "u", f"line {t}" if t % 3 else f"> line {t - 1}\nreply {t}") for t in range(500)]
    assert rows_of(quotes.conversations(frame(llm_spark, rows))) == oracle(quotes.SQL, conversations=arrow(rows))


def test_no_python_in_the_plan(llm_spark):
    plan = quotes.conversations(frame(llm_spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PARTS = [
    (1, 0, "a", "First line here.\nSecond line there.\nThird one. And a tail!\n\nOther paragraph"),
    (1, 1, "b", "Second line there.\nThird one."),
    (1, 2, "c", "> Second line there.\n> Third one. And a tail!\nlines of a paragraph"),
    (1, 3, "d", "> And a tail\nsentence of a line"),
    (1, 4, "e", "> Third one. And a\n> tail! Other\n> paragraph\nwrapped, over paragraphs"),
    (1, 5, "f", "> Second line there.\n> nobody said this\nhalf of it"),
    (1, 6, "g", "> And a tail\n> lines of a paragraph\nfrom two messages"),
    (1, 7, "h", "> Third one. Second line there.\nsaid by 0 and 1: the earliest"),
    (1, 8, "i", ">> Third one. And a tail!\n> sentence of a line\nnested"),
    (1, 9, "j", "> future words now\nnot yet said"),
    (1, 9, "k", "future words. now later"),
    (1, 10, "l", "later"),
    (2, 0, "m", "> And a tail\nanother conversation"),
]


def test_parts_of_messages_link(llm_spark):
    out = {(r.conv_id, r.role): r for r in quotes.conversations(frame(llm_spark, PARTS), partial=True).collect()}
    assert [out[1, c].reply_to for c in "abcdefghijkl"] == [None, None, 0, 0, 0, None, None, 0, 3, None, None, None]
    assert out[1, "i"].n_linked == 2 and out[1, "f"].n_linked == 0 and out[2, "m"].reply_to is None
    assert out[1, "c"].content == "lines of a paragraph" and out[1, "i"].thread_turn == 0
    plain = {(r.conv_id, r.role): r for r in quotes.conversations(frame(llm_spark, PARTS)).collect()}
    assert plain[1, "c"].reply_to is None and plain[1, "i"].reply_to == 3  # a whole line links without it


def _held(rows, conv, turn, said):
    """Brute force of ``held``."""
    import re
    norm = lambda t: re.sub(r"[\W_]+", " ", t).strip().lower()
    cut = lambda t: re.split(r"[.!?…]+(?=\s|$)", t)
    unit = lambda ps: {norm(p) for p in ps} - {""}
    best = None
    for c, t, _, text in rows:
        if c == conv and t < turn and not text.startswith(">"):
            has = unit(text.split("\n")) | unit(s for l in text.split("\n") for s in cut(l)) | unit(
                s for p in re.split(r"\n[ \t]*\n", text) for s in cut(p.replace("\n", " ")))
            for want in (unit(said.split("\n")), unit(cut(said.replace("\n", " ")))):
                if want and want <= has and (best is None or t < best):
                    best = t
    return best


def test_parts_against_brute_force(llm_spark):
    import random
    rnd = random.Random(5)
    words = ["yes", "no way", "it is so", "maybe", "thanks a lot"]
    def text(n):
        return "".join(rnd.choice(words) + rnd.choice([". ", "! ", "\n", ".\n", "\n\n"]) for _ in range(n)).strip()
    rows = [(rnd.randrange(3), t, "u", text(rnd.randrange(1, 6))) for t in range(60)]
    asked = [(c, 60 + i, text(rnd.randrange(1, 4)).replace("\n\n", "\n")) for i, c in enumerate([0, 1, 2] * 12)]
    asked += [(c, 5 + i, text(2).replace("\n\n", "\n")) for i, c in enumerate([0, 1, 2] * 4)]
    parsed = quotes.parse(frame(llm_spark, rows))
    got = quotes.held(parsed, llm_spark.createDataFrame(asked, "conv_id long, turn long, said string"))
    got = {(r.conv_id, r.turn, r.said): r.part_turn for r in got.collect()}
    want = {a: _held(rows, *a) for a in asked}
    assert got == {a: t for a, t in want.items() if t is not None} and 5 < len(got) < len(want)


def test_partial_is_native_and_defined_on_odd_rows(llm_spark):
    out = quotes.conversations(frame(llm_spark, ROWS), partial=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and out.count() == len(ROWS)
    assert quotes.conversations(frame(llm_spark, []), partial=True).count() == 0
    assert {r.turn: r.reply_to for r in out.where("conv_id = 1").collect()}[4] == 2  # 'Next' is a sentence of turn 2


def test_one_long_thread_is_ranked_in_blocks(llm_spark, oracle, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", 32)
    rows = [(9, t, "u", f"> line {t - 1}\nline {t}" if t else "line 0") for t in range(300)]
    out = quotes.conversations(frame(llm_spark, rows))
    assert {r.thread_turn for r in out.collect()} == {0}
    assert rows_of(out) == oracle(quotes.SQL, conversations=arrow(rows))
