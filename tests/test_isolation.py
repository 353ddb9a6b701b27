"""Nothing outside the training-data package imports it."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "noesis"


def test_core_stands_alone():
    for f in ROOT.rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"noesis\.llm|import llm", f.read_text()), f
