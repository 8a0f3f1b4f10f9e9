"""Path keys, priority, language and type on literal paths."""
from pyspark.sql import functions as F

from quire.functions.paths import basename, custom_sort_key, ext_last, ext_name, file_priority, language_of, top_dir, type_of


def _eval(spark, paths, *cols):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r[0]: tuple(r[1:]) for r in df.select("path", *cols).collect()}


def test_priority_examples(spark):
    got = _eval(spark, ["README.md", "package.json", "src/index.js", "src/utils.js", "test/a.js", "docs/x.md",
                        "latest/x.txt", "src/test/x.py", "src/apple.js", "lib/a.py", "other.txt",
                        "config/app.yaml", "Config.ts", ".env.example", "main.go", "a/main.rs"],
                file_priority("path"))
    assert got["README.md"] == (0,)
    assert got["package.json"] == (1,)
    assert got["src/index.js"] == (2,)          # base name matches before the path rule
    assert got["src/utils.js"] == (100,)
    assert got["test/a.js"] == (200,)
    assert got["docs/x.md"] == (201,)
    assert got["latest/x.txt"] == (200,)         # 'test/' is a substring of 'latest/'
    assert got["src/test/x.py"] == (100,)
    assert got["src/apple.js"] == (10,)
    assert got["lib/a.py"] == (101,)
    assert got["other.txt"] == (150,)
    assert got["config/app.yaml"] == (6,)
    assert got["Config.ts"] == (6,)
    assert got[".env.example"] == (7,)
    assert got["main.go"] == (3,)
    assert got["a/main.rs"] == (3,)


def test_path_keys(spark):
    got = _eval(spark, ["src/Makefile", "a.b/c", "x/y.TS", ".env", "dir/.hidden.txt", "readme"],
                basename("path"), ext_name(basename("path")), ext_last("path"), top_dir("path"),
                language_of("path"), type_of("path"))
    assert got["src/Makefile"] == ("Makefile", "", "src/makefile", "src", "src/makefile", "other")
    assert got["a.b/c"] == ("c", "", "b/c", "a.b", "b/c", "other")
    assert got["x/y.TS"] == ("y.TS", "ts", "ts", "x", "typescript", "typescript")
    assert got[".env"] == (".env", "", "env", "_root", "env", "other")
    assert got["dir/.hidden.txt"] == (".hidden.txt", "txt", "txt", "dir", "text", "docs")
    assert got["readme"] == ("readme", "", "readme", "_root", "readme", "other")


def test_custom_sort_key(spark):
    df = spark.createDataFrame([("src/core/a.js", 100), ("tests/x.js", 200), ("b.md", 150)], "path string, priority int")
    got = dict(df.select("path", custom_sort_key(["core", "tests", "core"]).alias("k")).collect())
    assert got == {"src/core/a.js": 2 - 1000, "tests/x.js": 1 - 1000, "b.md": 150}
