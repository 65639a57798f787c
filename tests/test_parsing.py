from gritmeter.operators import parsing as P

PY = '''import os, sys
from a.b import *
class A:
    _instance = None
    items = []
    typed: int = 3
    @classmethod
    def get_instance(cls):
        if cls._instance is None and True:
            for x in y:
                while z:
                    pass
        elif q:
            return 1 if a else 2
        return cls._instance

setup(1,
  2)
print("x")
def outer(
    a,
):
    try:
        with x: pass
    except: pass
    def inner(): return 1
'''
JS = """import {a} from "./mod";
import 'side';
class S { static _instance = null; static getInstance() { if (!S._instance) { S._instance = new S(); } return S._instance; } }
window.addEventListener("x", () => { go(); });
app.get("/", (req, res) => { res.send(1); });
function f(a, b) { for (const i of a) { if (i > 2 && b) { switch (i) { case 1: break; } } } return a ? b : 1; }
const g = x => x * 2;
"""


def test_python_functions():
    assert P.functions_of("Python", PY) == [("get_instance", 8, 8, 7, 3), ("outer", 20, 7, 3, 2), ("inner", 26, 1, 1, 0)]


def test_python_strict_adds_anonymous_row_for_decorated():
    assert ("<anonymous>", 7, 9, 7, 3) in P.functions_of("Python", PY, strict=True)


def test_python_imports_take_first_module_only():
    assert P.imports_of("Python", PY) == [("os", 1), ("a.b", 2)]


def test_python_hazards():
    assert sorted(P.hazards_of("Python", PY), key=lambda h: h[1]) == [("SingletonPattern", 3), ("MutableClassVariable", 5), ("ModuleLevelCall", 17)]


def test_js():
    names = [f[0] for f in P.functions_of("JavaScript", JS)]
    assert names == ["getInstance", "<anonymous>", "<anonymous>", "f", "x"]
    assert P.imports_of("JavaScript", JS) == [("./mod", 1), ("side", 2)]
    assert P.hazards_of("JavaScript", JS) == [("SingletonPattern", 3), ("GlobalEventListener", 4), ("ModuleLevelCall", 5)]


def test_clean_class_has_no_hazard():
    assert P.hazards_of("JavaScript", "class A { run() { return 1; } }\n") == []


def test_rust_impl_only_in_strict():
    code = "impl A {\n fn b(x: i32) -> i32 {\n match x { 1 => 2, _ => 3 }\n }\n}\n"
    assert P.functions_of("Rust", code) == [("b", 2, 3, 3, 1)]
    assert P.functions_of("Rust", code, strict=True)[0][0] == "<anonymous>"


def test_other_languages():
    assert P.functions_of("Go", "func (s *S) Run(a int) error {\n if a > 1 {\n  for i := 0; i < 3; i++ {\n  }\n }\n return nil\n}\n") == [("Run", 1, 7, 3, 2)]
    assert P.functions_of("C", "int main(int c) {\n  while (c) { c--; }\n  return 0;\n}\n") == [("main", 1, 4, 2, 1)]
    assert [f[0] for f in P.functions_of("Java", "class A { int f(int a) { if (a>1) { return 2; } return 1; } A() { } }")] == ["f", "A"]
    assert P.functions_of("Ruby", "def x?(a)\n  if a\n    1\n  end\nend\n") == [("x?", 1, 5, 2, 1)]
    assert [f[:1] + f[3:] for f in P.functions_of("PHP", "<?php\nfunction m($a) { foreach ($a as $b) { if ($b) {} } }\n$f = function($x) { return $x; };")] == [("m", 3, 2), ("<anonymous>", 1, 0)]


def test_imports_of_other_languages():
    assert P.imports_of("Go", 'import (\n "fmt"\n x "a/b"\n)\nimport "os"\n') == [("fmt", 2), ("a/b", 3), ("os", 5)]
    assert P.imports_of("Rust", "use std::fmt;\n") == [("std::fmt", 1)]
    assert P.imports_of("C", '#include <stdio.h>\n#include "x.h"\n') == [("stdio.h", 1), ("x.h", 2)]
    assert P.imports_of("Java", "import java.util.List;\n") == [("java.util.List", 1)]


def test_broken_code_is_read_as_far_as_it_goes():
    assert [f[0] for f in P.functions_of("JavaScript", "function a() { if (x {\nfunction b() {")][0] == "a"
    assert P.functions_of("Python", "def (") == []


def test_nothing_in_empty_text():
    for language in P.L.PARSED:
        assert P.functions_of(language, "") == [] and P.imports_of(language, "") == [] and P.hazards_of(language, "") == []


def test_semicolons_of_a_loop_head_dont_end_it():
    assert P.functions_of("C", "int f(int n){ for (int i=0;i<n;i++) { if (i) {} } }") == [("f", 1, 1, 3, 2)]
    assert P.functions_of("JavaScript", "function f(n){ for(let i=0;i<n;i++){ if(i){ while(1){} } } }")[0][4] == 3


def test_else_if_nests_in_its_if():
    assert P.functions_of("Java", "class A { int f(){ if(a){ x(); } else if (b) { y(); } else { while(c){} } } }") == [("f", 1, 1, 4, 3)]
    assert P.functions_of("PHP", "<?php function f($a){ if($a){ try { x(); } catch (E $e) { if ($e) {} } } }")[0][4] == 3


def test_a_function_inside_a_condition_keeps_the_condition_open():
    assert P.functions_of("JavaScript", "function o(){ if (a.some(function(x){ if (x) { return 1 } })) { for(;;){} } }") == [("o", 1, 1, 4, 2), (P.ANONYMOUS, 1, 1, 2, 1)]


def test_js_regular_expressions_and_templates():
    assert [f[0] for f in P.functions_of("JavaScript", "function f(){ return /[{]/.test(x) }\nfunction g(){ return a / 2 / b }")] == ["f", "g"]
    assert P.functions_of("JavaScript", "function f(){ return `${x && `${y ? 1 : 2}`} }` }") == [("f", 1, 1, 3, 0)]


def test_python_conditional_expressions_and_comprehensions():
    assert P.functions_of("Python", "def f():\n    return [x for x in y if x] if z else w\n")[0][3] == 2
    assert P.functions_of("Python", "def f():\n    a = [\n        x\n        for x in y\n        if x\n    ]\n    if a:\n        pass\n    else:\n        pass\n")[0][3:] == (2, 1)


def test_imports_in_texts_and_comments_are_none():
    assert P.imports_of("Python", '"""\nimport os first\n"""\nimport a.b, c; import d\nimport numpy as np\nfrom . import z\nfrom __future__ import q\n') == [("a.b", 4), ("d", 4), (".", 6)]
    assert P.imports_of("JavaScript", "/* import x from 'no' */\nimport('d');\nimport a from 'a'; import {b,\n c} from 'b'\nimport 's'\n// import 'z'\n") == [("a", 3), ("b", 3), ("s", 5)]
    assert P.imports_of("Go", '// import "no"\nimport "os"\n/*\nimport "never"\n*/\n') == [("os", 2)]


def test_deep_nesting_takes_linear_time():
    import time

    start = time.time()
    assert len(P.functions_of("JavaScript", "const a = () => {\n" * 4000 + "}" * 4000)) == 4000
    assert len(P.functions_of("JavaScript", "a => " * 4000 + "1;\n")) == 4000
    assert time.time() - start < 10


def test_strict_rows_of_keyword_tokens():
    assert P.functions_of("JavaScript", "function f(){}", strict=True) == [("f", 1, 1, 1, 0), (P.ANONYMOUS, 1, 1, 1, 0)]
    assert P.functions_of("Ruby", "def x(a)\n  if a\n    1\n  end\nend\n", strict=True) == [("x", 1, 5, 3, 2)]
