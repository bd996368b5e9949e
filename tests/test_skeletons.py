"""Skeletons of definitions: signatures stay, bodies go."""

from __future__ import annotations

import pytest

from lorekeep.functions import text as T

RUST = {
    "pub fn norm(&self) -> f64 {\n    (self.x * self.x + self.y * self.y).sqrt()\n}": "pub fn norm(&self) -> f64 { … }",
    "pub struct Point {\n    x: f64,\n}": "pub struct Point { … }",
    "pub(crate) struct Pair(f64, f64);": "pub(crate) struct Pair { … }",
    "struct Unit;": "struct Unit",
    "fn f(x: [u8; { N }]) -> u8 { x[0] }": "fn f(x: [u8; { N }]) -> u8 { … }",
    "fn g() /* a { brace */ -> u8 // and { one\n{ 1 }": "fn g() /* a { brace */ -> u8 // and { one { … }",
    'extern "C{" fn h(c: char) { let q = \'{\'; }': 'extern "C{" fn h(c: char) { … }',
    'fn s(x: M<"a\\\\\\"{">) {}': 'fn s(x: M<"a\\\\\\"{">) { … }',
    'fn r(x: A<r#"{" quoted"#>) where A: Fn(u8) {}': 'fn r(x: A<r#"{" quoted"#>) where A: Fn(u8) { … }',
    "fn l<'a>(x: &'a str, y: &'a str) -> &'a str { x }": "fn l<'a>(x: &'a str, y: &'a str) -> &'a str { … }",
    "fn required(&self) -> u8;": "fn required(&self) -> u8",
    "const fn k() -> u8 { 3 }": "const fn k() -> u8 { … }",
    "const P: Point = Point { x: 1.0 };": "const P: Point = Point { x: 1.0 }",
    "mod inner { pub enum Direction { North } }": "mod inner { … }",
    "": "",
}
GENERIC = {"\n  \n　def f(x): {{ \nrest": "def f(x):", "a" * 300: "a" * 200, " \n\t": "", "é { x\n": "é { x", "class A {\r\n": "class A"}


@pytest.mark.parametrize(("name", "cases"), [("rust_skeleton", RUST), ("generic_skeleton", GENERIC)])
def test_skeletons(spark, name, cases):
    frame = spark.createDataFrame([(k,) for k in [*cases, None]], "x string")
    got = {r[0]: r[1] for r in frame.select("x", getattr(T, name)("x")).collect()}
    assert got.pop(None) is None
    assert got == cases


def test_a_very_long_body_and_comment(spark):
    long = "fn f() /* " + "* \" ' " * 100_000 + "*/ {\n" + 'let s = "\\"{"; ' * 20_000 + "}"
    got = spark.createDataFrame([(long,)], "x string").select(T.rust_skeleton("x")).head()[0]
    assert got == long[: long.index("*/ {") + 2] + " { … }"
