import pytest
from pyspark.sql import functions as F

from quarry.functions import files as X
from quarry.functions import modules as M

NAMES = [
    ("src/app/orders.py", "python", "app.orders"), ("pkg/__init__.py", "python", "pkg"), ("src/x.py", "python", "x"), ("src/main/java/com/acme/Foo.java", "java", "com.acme.Foo"), ("app/src/main/kotlin/com/acme/Foo.kt", "kotlin", "com.acme.Foo"), ("lib/a/b.py", "python", "a.b"),
    ("internal/billing/rates.go", "go", "package:internal/billing"), ("main.go", "go", "package:."), ("app/Models/Order.php", "php", "namespace:app/models/order"), ("web/ui/index.ts", "typescript", "relative:web/ui"),
    ("web/config.schema.ts", "typescript", "relative:web/config.schema"), ("index.ts", "typescript", "relative:."), ("a.py", "python", "a"), ("src.py", "python", "src"),
]
IMPORTS = [
    ("pkg/a.py", "python", ".b", "pkg.b"), ("pkg/a.py", "python", "..c", "c"), ("src/pkg/sub/a.py", "python", "..c", "pkg.c"), ("pkg/__init__.py", "python", ".", "pkg"), ("x.py", "python", "os.path", "os.path"),
    ("web/a/b.ts", "typescript", "../c", "relative:web/c"), ("web/a/b.ts", "typescript", "./d.js", "relative:web/a/d"), ("web/a/b.ts", "typescript", "react", "relative:react"), ("web/a/b.ts", "typescript", "./ui/index", "relative:web/a/ui"), ("b.ts", "typescript", "./config.schema", "relative:config.schema"),
    ("cmd/m.go", "go", "github.com/o/r/internal/x", "package:internal/x"), ("cmd/m.go", "go", "fmt", "package:fmt"), ("app/A.php", "php", "App\\Models\\Order", "namespace:app/models/order"),
]


def test_module_names(spark):
    df = spark.createDataFrame(NAMES, "path string, lang string, expected string")
    for r in df.withColumn("got", M.module_name(F.col("path"), F.col("lang"))).collect():
        assert r.got == r.expected, r


def test_imports(spark):
    df = spark.createDataFrame(IMPORTS, "importer string, lang string, module string, expected string")
    for r in df.withColumn("got", M.resolve_module(F.col("importer"), F.col("lang"), F.col("module"))).collect():
        assert r.got == r.expected, r


@pytest.mark.parametrize("module, receiver, expected", [("a.b.rates", "rates", True), ("package:internal/rates", "rates", True), ("namespace:app/order", "Order", True), ("a.b", "a", False), ("relative:web/x.y", "y", False)])
def test_receivers(spark, module, receiver, expected):
    assert spark.range(1).select(M.receiver_names(F.lit(module), F.lit(receiver))).first()[0] == expected


def test_submodules(spark):
    row = spark.range(1).select(*[M.submodule(F.lit(m), F.lit("x")) for m in ("a.b", "", "package:p", "namespace:")]).first()
    assert list(row) == ["a.b.x", "x", "package:p/x", "namespace:x"]


def test_files(spark):
    rows = [("a/b.PY", "python", True), ("a.tsx", "tsx", True), ("node_modules/a.js", "javascript", False), (".cache/a.js", "javascript", False), (".github/a.yml", "yaml", True), ("Makefile", "", False), (".py", "", False)]
    df = spark.createDataFrame(rows, "path string, lang string, ok boolean")
    for r in df.select("*", X.language(F.col("path")).alias("l"), X.indexable(F.col("path"), F.lit(10)).alias("i")).collect():
        assert (r.l, r.i) == (r.lang, r.ok), r
    assert spark.range(1).select(X.excluded(F.lit("gen/a.py"), ["gen/*"]), X.excluded(F.lit("gen"), ["gen/"]), X.excluded(F.lit("a.py"), ["gen/*"]), X.trigrams(F.lit("abcabc").cast("binary")), X.trigrams(F.lit("ab").cast("binary"))).first()[:] == (True, True, False, 3, 0)
