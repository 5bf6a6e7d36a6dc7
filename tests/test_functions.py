import math

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import color as C
from mosaiq.functions import dates as D
from mosaiq.functions import hashing as H
from mosaiq.functions import text as T
from mosaiq.operators import filters, paging


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(("word", "want"), [("cities", "city"), ("beaches", "beach"), ("glass", "glass"), ("buses", "bus"), ("ties", "tie"), ("dunes", "dun"), ("cats", "cat"), ("gas", "gas")])
def test_stem(spark, word, want):
    assert one(spark, T.stem(F.lit(word))) == (want,)


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("The DUNES of Café, 2x sand-dunes!")), T.tokens(F.lit(None).cast("string")), T.tokens(F.lit(""))) == (["dun", "caf", "sand", "dun"], [], [])
    assert filters._query_tokens("The DUNES of Café, 2x sand-dunes!") == ["dun", "caf", "sand", "dun"]


def test_text_sizes_and_names(spark):
    assert one(spark, T.byte_size(F.lit(512)), T.byte_size(F.lit(1536)), T.byte_size(F.lit(2_621_440))) == ("512 B", "2 KB", "2.5 MB")
    assert one(spark, T.file_slug(F.lit("  Misty Mountains! ")), T.file_slug(F.lit("ß")), T.pin_slug(F.lit("Misty Mountains"), F.lit("3f9a2b"))) == ("misty-mountains", "image", "misty-mountains-3f9a2b")
    assert one(spark, T.content_disposition(F.lit('Café "x".jpg')))[0] == "attachment; filename=\"Caf x.jpg\"; filename*=UTF-8''Caf%C3%A9%20%22x%22.jpg"
    asset = "https://res.cloudinary.com/demo/image/upload/"
    assert one(spark, T.sized_asset_url(F.lit(asset + "v1/a.jpg"), 320))[0] == asset + "f_auto,q_auto,c_limit,w_320,dpr_auto/v1/a.jpg"
    assert one(spark, T.sized_asset_url(F.lit("https://e.invalid/a.jpg")), T.sized_asset_url(F.lit(asset + "w_10/a.jpg"))) == ("https://e.invalid/a.jpg", asset + "w_10/a.jpg")
    assert one(spark, T.normal_tags(F.lit(" Sea, sun ,,SEA"))) == (["sea", "sun"],)


def test_time_ago(spark):
    now = 1_700_000_000_000
    ago = lambda ms: D.time_ago(F.lit(now - ms).cast("long"), now)
    assert one(spark, ago(1000), ago(60_000), ago(3 * 3_600_000), ago(D.DAY_MS), ago(-D.DAY_MS), ago(60 * D.DAY_MS), ago(366 * D.DAY_MS), ago(-7_200_000)) == ("just now", "1 minute ago", "3 hours ago", "yesterday", "tomorrow", "2 months ago", "last year", "in 2 hours")


def test_colours(spark):
    white = C.to_lab(C.rgb(255, 255, 255))
    l, a, b = one(spark, *white)
    assert math.isclose(l, 100, abs_tol=1e-3) and abs(a) < 0.01 and abs(b) < 0.01
    for c in ((0, 0, 0), (255, 0, 0), (12, 200, 77), (224, 36, 36), (30, 30, 33), (250, 250, 1)):
        got = one(spark, C.family(C.rgb(*c)), C.to_hex(C.rgb(*c)), *C.to_lab(C.rgb(*c)))
        assert got[0] == C.family_of(*c) and got[1] == "#%02x%02x%02x" % c
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(got[2:], C.lab_of(*c), strict=True))
    assert one(spark, *C.from_hex(F.lit(" #F0a"))) == (255, 0, 170)
    assert one(spark, *C.from_hex(F.lit("12345"))) == (None, None, None)
    assert one(spark, C.readable_on(C.rgb(255, 255, 0)), C.readable_on(C.rgb(0, 0, 80))) == ("#000000", "#ffffff")
    for name, _, swatch in C.FAMILIES:
        assert C.family_of(*(int(swatch[i : i + 2], 16) for i in (1, 3, 5))) == name
    assert C.families_near(128, 128, 128) is None and C.families_near(224, 36, 36) == ["pink", "red", "orange", "neutral"]


def test_hashes(spark):
    top = "8000000000000001"
    assert one(spark, H.hash_text(H.hash_bits(F.lit(top))), H.hamming(H.hash_bits(F.lit(top)), H.hash_bits(F.lit("f" * 16)))) == (top, 62)
    assert one(spark, H.bit_array(H.hash_bits(F.lit(top))))[0] == [i in (0, 63) for i in range(64)]
    assert one(spark, *[H.is_hash(F.lit(x)) for x in ("F" * 16, "f" * 15, "f" * 16 + "\n", "f" * 16)]) == (False, False, False, True)
    assert one(spark, *[H.classify(F.lit(x)) for x in (4, 5, 10, 11)]) == ("identical", "near-duplicate", "near-duplicate", "distinct")


def test_cursors():
    c = paging.encode_cursor(1700000000000, "a.b")
    assert paging.decode_cursor(c) == (1700000000000, "a.b")
    assert [paging.decode_cursor(x) for x in (None, "", "%%%", paging.encode_cursor("x", "1"), paging.encode_cursor(1, ""))] == [None] * 5
    for p in (("stored", c), ("external", 3, 2)):
        assert paging.decode_feed_cursor(paging.encode_feed_cursor(p)) == p
    assert paging.decode_feed_cursor("junk") == ("stored", None)
    assert [paging.clamp(x) for x in (None, 0, 7, 1000)] == [24, 1, 7, 100]
