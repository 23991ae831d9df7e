import logging

import pytest

from millrace import helpers


def test_chunks_keys_and_folders(tmp_path):
    assert list(helpers.chunked(range(5), 2)) == [[0, 1], [2, 3], [4]] and list(helpers.chunked([], 3)) == []
    with pytest.raises(ValueError):
        list(helpers.chunked([1], 0))
    assert helpers.check_keys({"a": 1}, ["a", "b"]) == ["b"]
    with pytest.raises(ValueError, match="unknown"):
        helpers.check_keys({"a": 1, "z": 2}, ["a"], ["b"])
    assert helpers.ensure_folder(tmp_path / "x" / "y").is_dir()


def test_logger_is_set_up_once():
    assert helpers.logger("t") is helpers.logger("t") and len(logging.getLogger("t").handlers) == 1
