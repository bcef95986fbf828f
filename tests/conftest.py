import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app_name="ledgerlens-tests")
    yield s
    s.stop()


@pytest.fixture()
def tree(tmp_path):
    """Write a CSV tree: ``tree({"2025/07/01/name.csv": "text", ...})`` -> base path."""
    def write(files: dict[str, str | bytes]) -> str:
        base = tmp_path / "base"
        for rel, content in files.items():
            p = base / rel
            p.parent.mkdir(parents=True, exist_ok=True)
            if isinstance(content, bytes):
                p.write_bytes(content)
            else:
                p.write_text(content, encoding="utf-8")
        base.mkdir(exist_ok=True)
        return str(base)
    return write
