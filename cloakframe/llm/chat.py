"""Chat formatting of typed content parts, with column expressions only.

A turn's content is a text or an array of parts (structs with ``type`` and, as far as they have them, text, ref, width, height, seconds, pages). A visitor has
one method for each type of part: it gives the part's piece of the output and, for attachments, the reference and the number of tokens that the piece
stands for later. Pieces are joined in their order; of images, audio and documents only a placeholder is written. Each turn becomes
``<|im_start|>role``, a line end, the pieces, ``<|im_end|>``, a line end; a conversation is the turns in the order of ``turn``.

Texts are escaped so that ``<|`` stands in the output only where the template put it: ``<``, any number of backslashes and ``|`` gets one backslash more. In a role ``\\``, ``|``
and the line end become ``\\b``, ``\\p`` and ``\\n``. Both are undone exactly by ``read_back``, which sees nothing but the output. The loss mask is a list of spans (code points, end
exclusive), one for each turn: the text of the roles learned from, empty for other turns, so no marker and no role name is ever learned.

Null texts, contents and roles are empty. Parts that are null are left out, a type unknown to the visitor is an attachment ``<|other|>`` of no tokens. Turns with a null number come last;
equal numbers go by role, then by content; repeated rows are turns of their own. Rows with a null id are one conversation. A turn may be of any length; a conversation is
one row, so its output must fit one value (2 GB). An empty table gives an empty result. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from cloakframe.functions.hof import let, prefix_sums

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


class Visitor:
    """What becomes of each type of part: ``visit_<type>`` gives its piece, reference and number of tokens.

    An image counts one token for each patch of ``patch`` pixels, audio ``rate`` for each second, a document ``page`` for each page; sizes that are null count nothing.
    """

    def __init__(self, patch: int = 28, rate: int = 25, page: int = 512):
        self.patch, self.rate, self.page = patch, rate, page

    def visit_text(self, part: Column) -> Column:
        return self.made(escape(F.coalesce(part["text"], F.lit(""))), None, None, None)

    def visit_image(self, part: Column) -> Column:
        return self.made(F.lit("<|image|>"), "image", part["ref"], F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch))

    def visit_audio(self, part: Column) -> Column:
        return self.made(F.lit("<|audio|>"), "audio", part["ref"], F.ceil(part["seconds"] * self.rate))

    def visit_document(self, part: Column) -> Column:
        return self.made(F.lit("<|document|>"), "document", part["ref"], part["pages"] * self.page)

    def visit_other(self, part: Column) -> Column:
        return self.made(F.lit("<|other|>"), "other", part["ref"], F.lit(0))

    @staticmethod
    def made(piece: Column, kind: str | None, ref: Column | None, tokens: Column | None) -> Column:
        n = F.lit(0) if tokens is None else F.coalesce(tokens, F.lit(0))
        return F.struct(
            piece.alias("piece"), F.lit(kind).cast("string").alias("kind"), (F.lit(None) if ref is None else ref).cast("string").alias("ref"),
            n.cast("long").alias("n_tokens"))

    def types(self) -> list[str]:
        return sorted(m.removeprefix("visit_") for m in dir(self) if m.startswith("visit_") and m != "visit_other")

    def visit(self, part: Column) -> Column:
        out = self.visit_other(part)
        for kind in self.types():
            out = F.when(part["type"] == kind, getattr(self, f"visit_{kind}")(part)).otherwise(out)
        return out


FIELDS = {"type": "string", "text": "string", "ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}


def parts(content: Column, kind: DataType) -> Column:
    """Content of any accepted type as an array of parts with all fields."""
    if not isinstance(kind, ArrayType):
        one = F.struct(F.lit("text").alias("type"), F.coalesce(content.cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in list(FIELDS.items())[2:]])
        return F.array(one)
    has = set(kind.elementType.names)
    full = lambda p: F.struct(*[(p[c] if c in has else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
    return F.transform(F.filter(F.coalesce(content, F.array().cast(kind)), lambda p: p.isNotNull()), full)


def _turn(role: Column, pieces: Column, learned: tuple[str, ...]) -> Column:
    """A formatted turn, where its text lies in it, and its attachments with the code point where each placeholder begins."""
    head = F.concat(F.lit(BEGIN), escape_role(role), F.lit("\n"))
    ends = prefix_sums(F.transform(pieces, lambda p: F.char_length(p["piece"]).cast("long")))
    place = lambda p, e: F.struct((e - F.char_length(p["piece"])).alias("at"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))
    placed = F.zip_with(pieces, ends, place)

    def made(h: Column, body: Column) -> Column:
        n = F.char_length(h).cast("long")
        found = F.filter(placed, lambda a: a["kind"].isNotNull())
        return F.struct(
            F.concat(h, body, F.lit(END)).alias("piece"), n.alias("begin"), F.when(role.isin(*learned), n + F.char_length(body)).otherwise(n).alias("end"),
            F.transform(found, lambda a: a.withField("at", a["at"] + n)).alias("attachments"))

    return let(head, lambda h: let(F.array_join(F.transform(pieces, lambda p: p["piece"]), ""), lambda body: made(h, body)))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", learned: tuple[str, ...] = LEARNED, visitor: Visitor | None = None) -> DataFrame:
    """conv_id, formatted, loss (start, end of each turn's learned text), turns (start, end), attachments (turn, at, kind, ref, n_tokens), expanded_tokens.

    ``turn`` of an attachment counts from 0, ``at`` is the code point of ``formatted`` where its placeholder begins.
    """
    visitor = visitor or Visitor()
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    content = parts(F.col(content_col), rows.schema[content_col].dataType)
    # the order of rows within a conversation is taken before texts are formatted; one shuffle serves the order, the offsets and the gathering
    read = rows.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_n"), role.alias("_role"), content.alias("_parts"))
    turns = read.select("_c", "_n", "_role", "_parts", F.transform("_parts", visitor.visit).alias("_pieces"))
    turns = turns.select("_c", "_n", "_role", "_parts", _turn(F.col("_role"), F.col("_pieces"), learned).alias("_t"))
    order = Window.partitionBy("_c").orderBy(F.col("_n").asc_nulls_last(), "_role", "_parts")
    upto = F.sum(F.char_length("_t.piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = turns.select("_c", "_t", F.row_number().over(order).alias("_i"), upto.alias("_upto"))
    begin = F.col("_upto") - F.char_length("_t.piece")
    found = F.transform("_t.attachments", lambda a: F.struct((F.col("_i") - 1).cast("long").alias("turn"), (a["at"] + begin).alias("at"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))
    one = F.struct(
        "_i", F.col("_t.piece").alias("piece"), begin.alias("start"), F.col("_upto").alias("end"),
        (begin + F.col("_t.begin")).alias("loss_start"), (begin + F.col("_t.end")).alias("loss_end"), found.alias("attachments"))
    whole = placed.groupBy("_c").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return whole.select(
        F.col("_c").alias(conv_col), F.array_join("t.piece", "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["loss_start"].alias("start"), t["loss_end"].alias("end"))).alias("loss"),
        F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("turns"),
        F.flatten("t.attachments").alias("attachments"),
        F.aggregate(F.flatten("t.attachments"), F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"))


def _raw_turns(formatted: Column) -> Column:
    """The turns of an output, each without its end marker; the marker's text cannot stand inside a turn."""
    cut = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text, placeholders>> of an output: texts as they were, placeholders as written, their types in order."""

    def turn(raw: Column) -> Column:
        head = F.substring_index(raw, "\n", 1)
        body = raw.substr(F.char_length(head) + 2, F.char_length(raw))
        return F.struct(
            unescape_role(head.substr(F.lit(len(BEGIN) + 1), F.char_length(head))).alias("role"), unescape(body).alias("text"),
            F.regexp_extract_all(body, F.lit(r"<\|(\w+)\|>"), F.lit(1)).alias("placeholders"))

    return F.transform(_raw_turns(formatted), turn)


def read_loss(formatted: Column, loss: Column, turns: Column) -> Column:
    """The text under each span of the loss mask, unescaped; spans are looked up inside their turn, so the work is linear."""
    spans = F.zip_with(loss, turns, lambda s, t: F.struct((s["start"] - t["start"]).cast("int").alias("at"), (s["end"] - s["start"]).cast("int").alias("n")))
    return F.zip_with(_raw_turns(formatted), spans, lambda raw, s: unescape(raw.substr(s["at"] + 1, s["n"])))
