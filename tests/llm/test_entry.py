"""The entry point without optional packages, and the shared folder of a cluster."""

import subprocess
import sys
from types import SimpleNamespace

import pytest

from stepchange.llm import common

BLOCKED = """
import sys
for name in ("ahocorasick", "sentencepiece", "public_tokenizers", "tokenizers", "tiktoken"):
    sys.modules[name] = None
import __spark_entry__ as entry
print(len(entry.queries()), sum(name.startswith("op") for name in entry.queries()))
"""


def test_queries_are_registered_without_optional_packages():
    found = subprocess.run([sys.executable, "-c", BLOCKED], capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    assert found.stdout.split()[0] >= "120" and found.stdout.split()[1] == "13"


def session(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: folder, set=lambda *a: None), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session(None, "spark://host:7077"))
    assert common.shared_folder(session("s3a://b/c/", "spark://host:7077")) == "s3a://b/c"
