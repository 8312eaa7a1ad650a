"""Calls in the order of a syntax tree, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from proofmill.functions import java


def names(spark, body, function):
    code = java.blank_literals(F.lit(f"void t() {{ {body} }}"))
    return spark.range(1).select(function(code).alias("n")).first().n


CASES = [
    ("", []),
    ("a(); b();", ["a", "b"]),
    ("x.f(h()).g(k());", ["f", "g", "k", "h"]),
    ("f(h(i()), j()).g();", ["f", "g", "h", "i", "j"]),
    ("f(a(b()).c(d())).g(e(f2()).h());", ["f", "g", "e", "h", "f2", "a", "c", "d", "b"]),
    ("new A(x()).f(y());", ["A", "f", "y", "x"]),
    ("new A(x()) { void m() { n(); } }.f();", ["A", "f", "x", "n"]),
    ("this.f(x()).g(y());", ["f", "x", "g", "y"]),
    ('"lit".f(x()).g(y());', ["f", "x", "g", "y"]),
    ("a[b()].f(x()).g();", ["b", "f", "x", "g"]),
    ("f(x()).field.g(y());", ["f", "g", "y", "x"]),
    ("f(x())[i()].g(y());", ["f", "i", "g", "y", "x"]),
    ("if (a(b())) { c(d()).e(); } else { g(); } h();", ["a", "b", "c", "e", "d", "g", "h"]),
    ("int y = p.q.f(x()) + g(h()).i() * j();", ["f", "x", "g", "i", "h", "j"]),
    ("for (int k = a(); b(k).c(); d()) { e(); }", ["a", "b", "c", "d", "e"]),
    ("assertEquals(f(x()).g(), fail(y()));", ["f", "g", "x", "y"]),
    ("run(() -> { a(b()).c(); }).d();", ["run", "d", "a", "c", "b"]),
    ("C.<T>f(x()).<U>g();", ["f", "g", "x"]),
    (")) a(b()).c();", ["a", "c", "b"]),
]


@pytest.mark.parametrize("body, want", CASES)
def test_order(spark, body, want):
    assert names(spark, body, java.call_names_in_tree_order) == want
    assert sorted(names(spark, body, java.call_names)) == sorted(want)
