from types import SimpleNamespace

import pytest

from sparkgap.session import cut_lineage


def test_a_cluster_without_a_shared_folder_is_an_error():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut_lineage(SimpleNamespace(sparkSession=session))


def test_the_named_folder_is_used():
    seen = {}
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077", setCheckpointDir=lambda path: seen.update(path=path))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: "/shared"))
    assert cut_lineage(SimpleNamespace(sparkSession=session, checkpoint=lambda eager: ("cut", eager))) == ("cut", True) and seen == {"path": "/shared"}
