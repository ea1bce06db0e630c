"""Function catalogue (C1-C4) against Python's own ast walk."""
from findings_lake.operators import catalog as C

SRC = '''import x

@decorator
def outer(a, b, /, c, *args, d=1, **kw):
    """Doc
       more."""
    def inner(z):
        return z
    f = lambda q: q
    return inner

class K:
    async def method(self, y):
        pass

def last():
    pass
'''


def test_catalogue_rules(spark):
    files = spark.createDataFrame([("a.py", SRC), ("b.py", "def broken(:\n"), ("c.py", "")],
                                  "file string, content string")
    cat = C.catalog(files)
    fns = C.functions(cat).orderBy("file", "fn_ord").collect()
    assert [f.name for f in fns] == ["outer", "inner", "method", "last"]
    o = fns[0]
    assert (o.lineno, o.end_lineno, o.args, o.docstring) == (4, 10, ["c"], "Doc\nmore.")
    assert o.source.startswith("def outer(a, b, /, c")
    assert fns[2].args == ["self", "y"]
    st = {r.file: (r.parse_ok, r.n_functions) for r in C.file_status(cat).collect()}
    assert st == {"a.py": (True, 4), "b.py": (False, 0), "c.py": (True, 0)}


def test_query_texts(spark):
    fns = spark.createDataFrame([("f", ["a", "b"], "", "def f(a, b): pass\n")],
                                "name string, args array<string>, docstring string, source string")
    t = C.scan_query_text(fns).first().query_text
    assert t == "Python function 'f' vulnerability analysis. Arguments: a, b.  def f(a, b): pass\n"
    t2 = C.tool_query_text(fns).first().query_text
    assert t2 == "Python function 'f' vulnerability. Args: a, b. def f(a, b): pass\n"
