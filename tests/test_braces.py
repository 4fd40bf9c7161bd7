"""Sources of languages with braces, read without a grammar; every expected row is worked out by hand."""

from codeloom.sources.braces import parse_braces

CPP = """#include <vector>
#define LIMIT 10
namespace app::gfx {
template <typename T, int N>
class Mesh : public Base<T, N>, private io::Writer {
 public:
  Mesh(int n) : size_(n) { init(n); }
  ~Mesh();
  virtual void draw(std::map<int, float> m) const = 0;
  static int count;  // a { brace }
 private:
  std::vector<int> size_ = {1, 2};
};
enum class Color { Red, Green };
typedef unsigned long word;
using Name = std::string;
}
void Mesh::draw(int a) { for (int i = 0; i < a; i++) { go("x { y"); } std::sort(v.begin(), v.end(), [](int a, int b) { return less(a, b); }); done(); }
int main() {
  run(1);
}
"""
TS = """import { a, b } from "./lib";
export interface Shape extends Base { area(): number; name?: string }
export class Circle extends Shape2 implements Shape {
  private r: number = 1
  constructor(r: number) { super(r); this.init() }
  async area(): Promise<number> {
    return compute(this.r)
  }
  handler = (e) => { fire(e) }
}
export const twice = (x: number) => {
  return add(x, x)
}
function plain(a, b) { twice(a) }
type Id = string | number
"""
JAVA = """package com.x.y;
import java.util.List;
public class A extends B implements C, D {
  private final int n = 0;
  public A(int n) { this.n = n; }
  @Override public List<String> names(Map<String, Integer> m) throws E { return load(m); }
}
interface C { void run(); }
"""
GO = """package main
import (
  "fmt"
  "os"
)
type Server struct {
  name string
  Port int
}
func (s *Server) Run(a int) error {
  fmt.Println(a)
  return nil
}
func main() {
  s := New()
  s.Run(1)
}
"""
CS = """using System;
namespace N.M {
  public class P : Q<int>, IR {
    public string Name { get; set; }
    public void Go(int a) { Help(a); }
  }
}
"""


def rows(language, text, *kinds):
    return [(k, n, line, p, t) for _, k, n, line, p, t in parse_braces("f", language, text) if k in kinds or not kinds]


def test_cpp():
    assert rows("cpp", CPP, "import", "macro", "namespace", "class", "inherits", "template", "enum", "typedef") == [
        ("import", "vector", 1, None, "vector"), ("macro", "LIMIT", 2, None, None), ("namespace", "app::gfx", 3, None, None), ("class", "Mesh", 5, "app::gfx", None), ("inherits", "Mesh", 5, "app::gfx", "Base"), ("inherits", "Mesh", 5, "app::gfx", "io::Writer"),
        ("template", "Mesh", 5, "app::gfx", None), ("enum", "Color", 14, "app::gfx", None), ("typedef", "word", 15, "app::gfx", None), ("typedef", "Name", 16, "app::gfx", None),
    ]
    assert rows("cpp", CPP, "constructor", "destructor", "method", "function", "field") == [
        ("constructor", "Mesh", 7, "Mesh", None), ("destructor", "~Mesh", 8, "Mesh", None), ("method", "draw", 9, "Mesh", None), ("field", "count", 10, "Mesh", None), ("field", "size_", 12, "Mesh", None), ("method", "draw", 18, "Mesh", None), ("function", "main", 19, None, None),
    ]
    assert {(n, p) for _, n, _, p, _ in rows("cpp", CPP, "call")} == {("init", "Mesh.Mesh"), ("go", "Mesh.draw"), ("sort", "Mesh.draw"), ("begin", "Mesh.draw"), ("end", "Mesh.draw"), ("less", "Mesh.draw"), ("done", "Mesh.draw"), ("run", "main")}


def test_typescript():
    assert rows("typescript", TS, "import", "interface", "class", "inherits", "typedef", "field") == [
        ("import", "./lib", 1, None, "./lib"), ("interface", "Shape", 2, None, None), ("inherits", "Shape", 2, None, "Base"), ("field", "name", 2, "Shape", None), ("class", "Circle", 3, None, None),
        ("inherits", "Circle", 3, None, "Shape2"), ("inherits", "Circle", 3, None, "Shape"), ("field", "r", 4, "Circle", None), ("typedef", "Id", 15, None, None),
    ]
    assert [r[1:4] for r in rows("typescript", TS, "constructor", "method", "function")] == [("area", 2, "Shape"), ("constructor", 5, "Circle"), ("area", 6, "Circle"), ("handler", 9, "Circle"), ("twice", 11, None), ("plain", 14, None)]
    assert [(r[1], r[3]) for r in rows("typescript", TS, "call")] == [("init", "Circle.constructor"), ("compute", "Circle.area"), ("fire", "Circle.handler"), ("add", "twice"), ("twice", "plain")]


def test_java_go_and_csharp():
    assert [r[:2] + r[3:] for r in rows("java", JAVA)] == [
        ("namespace", "com.x.y", None, None), ("import", "java.util.List", None, "java.util.List"), ("class", "A", None, None), ("inherits", "A", None, "B"), ("inherits", "A", None, "C"), ("inherits", "A", None, "D"),
        ("field", "n", "A", None), ("constructor", "A", "A", None), ("method", "names", "A", None), ("call", "load", "A.names", "load"), ("interface", "C", None, None), ("method", "run", "C", None),
    ]
    assert [r[:2] + r[3:] for r in rows("go", GO)] == [
        ("namespace", "main", None, None), ("import", "fmt", None, "fmt"), ("import", "os", None, "os"), ("struct", "Server", None, None), ("field", "name", "Server", None), ("field", "Port", "Server", None),
        ("method", "Run", "Server", None), ("call", "Println", "Server.Run", "Println"), ("function", "main", None, None), ("call", "New", "main", "New"), ("call", "Run", "main", "Run"),
    ]
    assert [r[:2] + r[3:] for r in rows("csharp", CS)] == [
        ("import", "System", None, "System"), ("namespace", "N.M", None, None), ("class", "P", "N.M", None), ("inherits", "P", "N.M", "Q"), ("inherits", "P", "N.M", "IR"), ("field", "Name", "P", None), ("method", "Go", "P", None), ("call", "Help", "P.Go", "Help"),
    ]


def test_text_that_is_no_code():
    assert rows("cpp", "") == [] and rows("cpp", "}}} class {{ ((( x") == []
    assert rows("go", "{" * 5000 + "}" * 6000) == [] and rows("cpp", '/* "open') == []
