"""Training-data operators over whole jobs, where an earlier form covered a part."""

import pytest

from lodestrata.llm import copies


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("---\na: 1\nb: 2\n", "b: 2\na: 1\n", True), ("%YAML 1.2\n---\na: 1\nb: 2\n...\n", "%YAML 1.2\n---\nb: 2\na: 1\n", True), ("a: 1\n---\nb: 2\n", "b: 2\n---\na: 1\n", False),
        ("k: {b: 1, a: 2}\n", "k: {a: 2, b: 1}\n", True), ("k: {b: 1, a: [x, {d: 3, c: 4}]}\n", "k:\n  a:\n  - x\n  - c: 4\n    d: 3\n  b: 1\n", True), ("k: {\n  b: 'x, y', # n\n  a: 2}\nj: 1\n", "j: 1\nk: {a: 2, b: 'x, y'}\n", False),
        ("- {b: 1, a: 2}\n- c\n", "- {a: 2, b: 1}\n- c\n", True), ("{b: 1, a: 2}\n", "a: 2\nb: 1\n", True), ("--- {b: 1, a: 2}\n", "{a: 2, b: 1}\n", True), ("k: [b, a]\n", "k: [a, b]\n", False), ("k: {\n  b: 'x, y',\n  a: 2}\nj: 1\n", "j: 1\nk: {a: 2, b: 'x, y'}\n", True),
        ("k: |\n  x: 1\n  a: 2\n", "k: |\n  a: 2\n  x: 1\n", False), ("- |\n  x: 1\n  a: 2\n", "- |\n  a: 2\n  x: 1\n", False), ("--- |\nx: 1\na: 2\n", "--- |\na: 2\nx: 1\n", False), ("k: >-\n  x: 1\n  a: 2\nj: 3\n", "j: 3\nk: >-\n  x: 1\n  a: 2\n", True),
    ],
)
def test_yaml_order(a, b, same):
    assert (copies._structured(a, "yaml") == copies._structured(b, "yaml")) == same
