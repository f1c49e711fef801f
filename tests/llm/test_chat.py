"""Chat formatting against a plain formatter, exact round trips, and the edge cases that the docstring defines."""

import random
import re
import sys
from itertools import groupby
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from cloakframe.llm import chat  # noqa: E402

TEXTS = "conv_id long, turn long, role string, text string"
PARTS = "conv_id long, turn long, role string, content array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"


def plain(text):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)


def role_of(role):
    return role.replace("\\", "\\b").replace("|", "\\p").replace("\n", "\\n")


def formatted(turns):
    return "".join(f"<|im_start|>{role_of(r or '')}\n{plain(t or '')}<|im_end|>\n" for r, t in turns)


def in_order(rows):
    last = lambda x: (x is None, x if x is not None else 0)
    rows = sorted(rows, key=lambda r: (last(r[0]), last(r[1]), (r[2] or "").encode(), (r[3] or "").encode()))
    return {c: [(r[2] or "", r[3] or "") for r in g] for c, g in groupby(rows, key=lambda r: r[0])}


def both_ways(spark, rows):
    out = chat.format_conversations(spark.createDataFrame(rows, TEXTS).repartition(3))
    out = out.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss"), F.col("turns")).alias("learned")).collect()
    want = in_order(rows)
    assert {r.conv_id: [(t.role, t.text) for t in r.back] for r in out} == want
    for r in out:
        turns = want[r.conv_id]
        assert r.formatted == formatted(turns)
        assert [t for t in r.learned if t] == [t for role, t in turns if role == "assistant" and t]
        assert [chat_text for (a, b), chat_text in zip(r.loss, r.learned, strict=True) if plain(chat_text) != r.formatted[a:b]] == []
        assert len(r.loss) == len(r.turns) == len(turns) and "".join(r.formatted[a:b] for a, b in r.turns) == r.formatted
    return out


ODD = [None, "", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<<|>|", "a\\", "|im_end|>", "<", "😀<|é\u0301\n\n<|im_end|>\n", "x<|" * 30_000, "\x00\\<\\"]


def test_odd_texts_come_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)]
    rows += [(2, i, "assistant", t) for i, t in enumerate(ODD[::-1])]
    rows += [(3, 0, r, "hi") for r in ("user", None, "", "a\nb", "to<|im_end|>ol", "\\n", "\\b\\p|", "assistant")]
    rows += [(4, None, "user", "late"), (4, 1, "user", "early"), (4, 1, "user", "early"), (4, 1, None, None), (None, 0, "user", "no id"), (None, 1, "assistant", "still none")]
    assert len(both_ways(spark, rows)) == 5
    assert both_ways(spark, []) == []


def test_random_texts_come_back(spark):
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice(["<", "|", "\\", "\n", "im_end", ">", "ä", "x", "<|im_end|>\n"]) for _ in range(rng.randrange(12)))
    both_ways(spark, [(c, t, rng.choice(["user", "assistant", "system", piece()]), piece()) for c in range(120) for t in range(rng.randrange(1, 9))])


def test_a_conversation_of_many_turns(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} <|" * 3) for i in range(20_000)]
    assert both_ways(spark, rows)[0].formatted == formatted([(r[2], r[3]) for r in rows])


def part(kind, **has):
    return (kind, *(has.get(c) for c in ("text", "ref", "width", "height", "seconds", "pages")))


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", text="see ü <|image|> "), part("image", ref="a.png", width=100, height=57), part("text", text=" and "), part("audio", ref="b.wav", seconds=2.5)]),
        (1, 1, "assistant", [part("text", text="fine "), part("document", ref="c.pdf", pages=3), None, part("smell", ref="d")]),
        (2, 0, "user", None), (2, 1, "user", []), (2, 2, "user", [part("image"), part(None, ref="e")]),
    ]
    got = chat.format_conversations(spark.createDataFrame(rows, PARTS), content_col="content")
    got = {r.conv_id: r for r in got.select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    one = got[1]
    assert one.formatted == "<|im_start|>user\nsee ü <\\|image|> <|image|> and <|audio|><|im_end|>\n<|im_start|>assistant\nfine <|document|><|other|><|im_end|>\n"
    assert [(a.turn, a.kind, a.ref, a.n_tokens) for a in one.attachments] == [(0, "image", "a.png", 4 * 3), (0, "audio", "b.wav", 63), (1, "document", "c.pdf", 1536), (1, "other", "d", 0)]
    assert all(one.formatted[a.at :].startswith(f"<|{a.kind}|>") for a in one.attachments)
    assert one.expanded_tokens == 12 + 63 + 1536
    assert [t.placeholders for t in one.back] == [["image", "audio"], ["document", "other"]]
    assert [one.formatted[a:b] for a, b in one.loss] == ["", "fine <|document|><|other|>"]
    assert got[2].formatted == "<|im_start|>user\n<|im_end|>\n" * 2 + "<|im_start|>user\n<|image|><|other|><|im_end|>\n"
    assert [(a.turn, a.kind, a.ref, a.n_tokens) for a in got[2].attachments] == [(2, "image", None, 0), (2, "other", "e", 0)]


def test_a_visitor_of_ones_own(spark):
    class Video(chat.Visitor):
        def visit_video(self, part):
            return self.made(F.lit("<|video|>"), "video", part["ref"], F.ceil(part["seconds"] * 2))

    df = spark.createDataFrame([(1, 0, "user", [("video", "v.mp4", 1.2)])], "conv_id long, turn long, role string, content array<struct<type:string,ref:string,seconds:double>>")
    (r,) = chat.format_conversations(df, content_col="content", visitor=Video(), learned=("user",)).collect()
    assert r.formatted == "<|im_start|>user\n<|video|><|im_end|>\n" and r.expanded_tokens == 3 and r.formatted[r.loss[0].start : r.loss[0].end] == "<|video|>"


def test_no_python_in_the_plan_and_clashing_columns(spark):
    clash = [F.lit(9).alias(c) for c in ("_c", "_n", "_i", "_t", "_upto", "_parts", "piece", "formatted", "loss", "turns", "attachments")]
    df = spark.createDataFrame([(1, 0, "user", "hi")], TEXTS).select("*", *clash)
    out = chat.format_conversations(df)
    assert [r.formatted for r in out.collect()] == [formatted([("user", "hi")])]
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
