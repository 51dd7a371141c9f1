import hashlib

import pytest
from pyspark.sql import functions as F

from ripplet.functions.ids import assert_no_collisions, assert_safe_ids, id_collisions, stable_id
from ripplet.functions.paths import extension, file_kind, folder, is_test_path, normalize_path
from ripplet.functions.text import bounded, estimate_tokens, plural, signature, utf16_length
from ripplet.model import check_label, check_properties, check_type


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_stable_id_is_52_bits_of_sha256(spark):
    keys = ["file:a", "symbol:ü:b", ""]
    want = [int(hashlib.sha256(k.encode()).hexdigest()[:13], 16) for k in keys]
    assert column(spark, keys, stable_id) == want and max(want) < 1 << 52


def test_collisions(spark):
    claims = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "id bigint, canonical_key string")
    assert [tuple(r) for r in id_collisions(claims).collect()] == [(2, "b", "c")]
    with pytest.raises(ValueError, match="share the id"):
        assert_no_collisions(claims)
    with pytest.raises(ValueError, match="safe range"):
        assert_safe_ids(spark.createDataFrame([(1 << 52,)], "id bigint"))


def test_paths(spark):
    assert column(spark, [".\\src\\a.ts", "./././x", "src/a.ts"], normalize_path) == ["src/a.ts", "././x", "src/a.ts"]
    tests = ["src/__tests__/cart.ts", "a/b.spec.tsx", "b.test.mjs", "test.js", "a.testing.ts", "__tests__"]
    assert column(spark, tests, is_test_path) == [True, True, True, False, False, True]
    kinds = ["a.test.d.ts", "src/types.d.cts", "x/vite.config.ts", "tsconfig-base.ts", "my-next.config.ts"]
    assert column(spark, kinds, file_kind) == ["declaration", "declaration", "config", "config", "source"]
    assert column(spark, ["a.d.ts", ".env", "Makefile", "a/b.c/d"], extension) == [".ts", "", "", ""]
    assert column(spark, ["a/b/c.ts", "c.ts"], folder) == ["a/b", ""]


def test_text(spark):
    assert column(spark, ["a😀", "", "12345678"], utf16_length) == [3, 0, 8]
    assert column(spark, ["a😀", "", "12345678", "123456789"], estimate_tokens) == [1, 0, 2, 3]
    assert column(spark, ["  a \u00a0\n\t b  "], bounded) == ["a b"]
    assert column(spark, ["function f(a:\n  B) { return {} }", "x" * 500], signature) == ["function f(a: B)", "x" * 280]
    assert column(spark, [1, 2], lambda c: plural(c, "file"), "int") == ["1 file", "2 files"]


def test_identifiers_are_checked():
    assert check_label("File") == "File" and check_type("CALLS") == "CALLS"
    assert check_properties(["b", "a_1"]) == ["a_1", "b"]
    for bad in (lambda: check_label("File) DELETE"), lambda: check_type("calls"), lambda: check_properties(["a", "a"]),
                lambda: check_properties(["1a"])):
        with pytest.raises(ValueError):
            bad()
