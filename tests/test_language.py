import pytest

from tracewright.plans.compiler import Pattern, compile_pattern, validate_pattern
from tracewright.plans.diagnostics import PatternError
from tracewright.plans.layout import format_pattern
from tracewright.plans.syntax import parse
from tracewright.sources.library import EXAMPLES, SHIPPED, UsageError, load_patterns, pattern_files

CALL = "call(kind: External)"


def pattern(evidence=f"required a: {CALL}", rest="", head="family: F severity: Low", version=1):
    return f"pattern p version {version} {{ {head} evidence {{ {evidence} }} {rest} }}"


def test_shipped_patterns_compile():
    assert [p.id for p in load_patterns()] == [
        "classic_reentrancy", "delegatecall_reachable_selfdestruct", "delegatecall_reachable_selfdestruct_transitive",
        "delegatecall_storage_collision", "oracle_manipulation", "spoofed_transfer_event", "unchecked_external_call", "unsafe_selfdestruct",
    ]
    assert len(load_patterns(EXAMPLES)) == 2


@pytest.mark.parametrize("path", [*pattern_files(SHIPPED), *pattern_files(EXAMPLES)], ids=lambda p: p.stem)
def test_shipped_patterns_are_canonical_and_round_trip(path):
    source = path.read_text()
    assert format_pattern(source) == source
    p = compile_pattern(source)
    assert Pattern.from_json(p.to_json()) == p


@pytest.mark.parametrize(
    "source, part",
    [
        (pattern(version=0), "at least 1"),
        (pattern(head="family: F severity: Low family: G"), "duplicate metadata key"),
        (pattern(head="severity: Low"), "`family`"),
        (pattern(head="family: F"), "`severity`"),
        (pattern(head='family: "F" severity: Low'), "bare identifier"),
        (pattern(head="family: F severity: Huge"), "not a recognized severity"),
        (pattern(head="family: F severity: Low tags: x"), "list of strings"),
        (pattern(evidence=""), "no evidence"),
        (pattern(evidence=f"optional a: {CALL}"), "only optional evidence"),
        (pattern(evidence=f"required a: {CALL} required a: {CALL}"), "duplicate evidence"),
        (pattern(evidence="required a: what(kind: External)"), "not a recognized predicate kind"),
        (pattern(evidence="required a: call(kind: External, kind: Create)"), "more than once"),
        (pattern(evidence="required a: call(kind: External, nope: 1)"), "not a recognized attribute"),
        (pattern(evidence="required a: call(kind: Nope)"), "not a recognized value"),
        (pattern(evidence="required a: call(kind: External, reentrant: 1)"), "wrong shape"),
        (pattern(evidence="required a: call(reentrant: true)"), "missing required attribute"),
        (pattern(evidence="required a: call(kind: StaticCall, reentrant: true)"), "incompatible"),
        (pattern(rest="constraint: b"), "not declared"),
        (pattern(rest="sequence: [a]"), "at least two steps"),
        (pattern(rest="sequence: [a, a]"), "more than once"),
        (pattern(rest="sequence: [a, b]"), "not declared"),
        (pattern(evidence=f"required a: {CALL} required b: {CALL}", rest="sequence: [a, b] within: 0"), "must be positive"),
        (pattern(rest="same_call: [a]"), "at least two members"),
        (pattern(rest="same_call: [a, a]"), "more than once"),
        (pattern(rest="same_call: [a, b]"), "not declared"),
        (pattern(rest="constraint: AND(a)"), "at least two operands"),
        (pattern(rest="constraint: and(a, a)"), "expected"),
        ("pattern p version 1 { family: F", "expected"),
        ('pattern p version 1 { family: "F', "unterminated string"),
        ("pattern sequence version 1 {}", "expected name"),
        (pattern(evidence="required a: call(kind: External,)"), "expected name"),
    ],
)
def test_errors(source, part):
    problems = validate_pattern(source)
    assert any(part in d.reason for d in problems if d.severity == "error"), problems
    with pytest.raises(PatternError):
        compile_pattern(source)


@pytest.mark.parametrize(
    "source, part",
    [
        (pattern(head="family: F severity: Low author: X"), "not a recognized metadata key"),
        (pattern(evidence=f"required a: {CALL} required b: {CALL}", rest="constraint: a"), "does not mention"),
    ],
)
def test_warnings_do_not_stop(source, part):
    assert [d.severity for d in validate_pattern(source)] == ["warning"] and part in validate_pattern(source)[0].reason
    compile_pattern(source)


def test_positions_are_lines_and_columns():
    source = "pattern p version 1 {\n  family: F\n  severity: Huge\n}"
    bad = next(d for d in validate_pattern(source) if "severity" in d.reason)
    assert bad.render(source).startswith("3:13: error:")


def test_recovery_reports_several_problems():
    _, problems = parse("pattern p version 1 { evidence { required : x required b: call(kind External) } constraint: }")
    assert len(problems) >= 3


def test_quirks_of_the_language():
    one = compile_pattern(pattern())
    assert one.constraint.op == "ref"  # one required clause is the constraint itself
    two = compile_pattern(pattern(evidence=f"required a: {CALL} required b: {CALL} optional c: {CALL}"))
    assert two.constraint.leaves() == [(0, False), (1, False)]
    again = compile_pattern(pattern(rest="constraint: NOT(a) constraint: a") + " and text that nobody reads")
    assert again.constraint.op == "ref"  # the later section counts
    long = compile_pattern(pattern(evidence=f"required a: {CALL} required b: {CALL}", rest=f"sequence: [a, b] within: {1 << 40}"))
    assert long.within is None
    tagged = compile_pattern(pattern(head='family: F severity: Low tags: ["x", "y", "x"]'))
    assert tagged.tags == ("x", "y")
    text = compile_pattern(pattern(evidence=r'required a: log(topic0: "a\"b\\c\n\t")'))
    assert text.clauses[0].attributes["topic0"] == 'a"b\\c\n\t'


def test_polarity_and_anchor():
    p = compile_pattern(pattern(evidence=f"required a: {CALL} required b: {CALL} optional c: {CALL}", rest="constraint: OR(NOT(b), NOT(NOT(a)))"))
    assert [p.polarity(i) for i in range(3)] == ["positive", "negative", "unreferenced"] and p.anchor == 0
    both = compile_pattern(pattern(rest="constraint: OR(a, NOT(a))"))
    with pytest.raises(ValueError):
        both.polarity(0)


def test_format_breaks_long_predicates_and_keeps_comments():
    source = "// kept\n// too\n" + pattern(evidence='required a: call(kind: External, reentrant: true, value_flow: Out, min_value: -3, selector: "0x12345678")')
    made = format_pattern(source)
    assert made.startswith("// kept\n// too\npattern p") and "call(\n            kind: External,\n" in made and "min_value: -3" in made
    assert format_pattern(made) == made


def test_pattern_library_errors(tmp_path):
    with pytest.raises(UsageError):
        pattern_files(tmp_path)
    with pytest.raises(UsageError):
        pattern_files(tmp_path / "none")
