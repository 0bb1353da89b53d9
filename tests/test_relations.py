import pytest
from support import SMALL, same

from tideloom.sources.relations import RELATIONS, Tables, with_relations


@pytest.mark.parametrize("name", RELATIONS)
def test_both_engines_agree(spark, duck, name):
    assert same(Tables(spark, SMALL)(name), duck.execute(with_relations(f"SELECT * FROM {{{name}}}"))) > 0
