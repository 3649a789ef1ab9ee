"""Character references against the standard library's decoder."""

import html
import random

from spanloom.functions import text as T

ODD = ["", None, "no reference", "&", "&&", "&;", "&#;", "&#x;", "& amp;", "&amp", "&amp;amp;", "&AMP;&LT&gt", "&notit;", "&notin;", "&not", "&copy2", "&copyright;", "&nosuch;", "&NotEqualTilde;", "&#233", "&#233;", "&#xE9;&#XE9", "&#128;&#129;&#159;", "&#0;", "&#xD800;", "&#x10FFFF;", "&#x110000;", "&#99999999999999999999;", "&#1;&#11;&#127;&#xFDD0;&#x1FFFE;", "&#13;&#10;&#9;&#12;", "&#00000000065;", "&#x0000000000041;", "a&b&c;d", "&" + "a" * 40 + ";", "&AMP" + "x" * 40, "😀&#128512;é&eacute;"]


def test_against_the_standard_library(spark):
    rng = random.Random(1)
    names = sorted(html.entities.html5)
    texts = ODD + [f"<&{n}x&{n.lower()} &{n[:-1]}>" for n in names]
    texts += ["".join(rng.choice(["&", "#", "x", ";", "1", "2", "a", "amp", "lt", "eacute", " ", "not", "in"]) for _ in range(12)) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", T.decode_references(rows["t"]).alias("x")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert not wrong, wrong[:10]
    assert got[1] is None
