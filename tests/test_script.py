from oreline.operators import script_code

TEXT = r'''
import a, { b as bee } from "./a";
import type { T } from "./types";
export * from '../b';
const c = require("./c");
/** Documented. */
export function choose(x: number, y?: string): number {
  if (x > 1 && y) {
    for (const q of [1, 2]) { while (q) { break; } }
  } else if (x) {
    throw new Error(`bad ${x ? 1 : 2}`);
  }
  return x ?? 0;
}

export const arrow = (ab) => ab.map((z) => z + 1);
class K { run(n) { try { n(); } catch (e) { switch (n) { case 1: break; default: } } } get /* not a doc */ v() { return /a\/[/]"/.test("x"); } }
do { c(); } while (c);
'''


def test_metrics():
    out = script_code.analyze(TEXT, False)
    assert out["parsed"], out["problem"]
    got = {m[0]: m for m in out["functions"]}
    assert out["imports"] == ["../b", "./a", "./c"]
    assert (got["choose"][1], got["choose"][2]) == (7, 14)
    assert got["choose"][4:] == (8, 3, True)
    assert got["run"][4:] == (3, 2, True)
    assert got["arrow"][5] == 1
    assert "v" in got
    assert (out["exported"], out["documented"]) == (2, 1)
    assert "TEMPLATE" in out["tokens"]


def test_failures():
    for bad in ("const a = `x", "f(", "a = [1, 2", "'open", "/* open", "}"):
        assert not script_code.analyze(bad, False)["parsed"], bad
    assert script_code.analyze("", False)["parsed"]
    assert script_code.analyze("export declare const a: number; import './x'", True)["imports"] == ["./x"]
