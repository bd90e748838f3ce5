"""Where shared files go."""

import types

import pytest

from millrace.errors import InvalidArgument
from millrace.session import checkpoint_dir


def fake(master, named=None):
    conf = types.SimpleNamespace(get=lambda key, default: named)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))


def test_a_cluster_must_name_its_folder():
    assert checkpoint_dir(fake("spark://host:7077", "/shared")) == "/shared"
    assert checkpoint_dir(fake("local[4]"), "/mine") == "/mine"
    with pytest.raises(InvalidArgument):
        checkpoint_dir(fake("spark://host:7077"), "/mine")
