"""Text functions over model responses."""

from pyspark.sql import Column, functions as F

from scenegrade.functions import json_docs as J


def first_json_object(text) -> Column:
    """First balanced ``{...}`` of a text, or the whole stripped text when it is wrapped
    in braces; NULL when there is none. Braces inside strings count too.

    The text from the first brace on is cut after every ``}``; depth can only reach
    zero at such a cut, so only the cuts are walked, not the characters.
    """
    s = J.strip(text)
    tail = F.substring(s, F.instr(s, "{"), F.length(s))
    pieces = F.split(tail, r"(?<=\})")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def step(acc, piece):
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = acc.depth + opened - piece.endswith("}").cast("int")
        pos = acc.pos + F.length(piece)
        closes = (acc.end == 0) & (depth == 0) & piece.endswith("}")
        return F.struct(depth.alias("depth"), pos.alias("pos"), F.when(closes, pos).otherwise(acc.end).alias("end"))

    end = F.aggregate(pieces, start, step, lambda acc: acc.end)
    return F.when(s.startswith("{") & s.endswith("}"), s).when(
        F.instr(s, "{") > 0, F.nullif(F.substring(tail, F.lit(1), end), F.lit(""))
    )


def data_url(extension, content) -> Column:
    """Inline media: ``data:video/<ext>;base64,...``; no extension means mp4."""
    ext = F.coalesce(F.nullif(F.lower(J.col(extension)), F.lit("")), F.lit("mp4"))
    encoded = F.replace(F.base64(J.col(content)), F.lit("\r\n"), F.lit(""))  # no MIME line breaks
    return F.concat(F.lit("data:video/"), ext, F.lit(";base64,"), encoded)
