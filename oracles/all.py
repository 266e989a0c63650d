"""Every oracle as a complete SQL text in the shape of its query."""

from oracles import evidence, inputs, policy, scores, structure  # noqa: F401
from oracles.base import ORACLES, expand
from pairscope.functions.shaping import shape_sql
from pairscope.plans.all_queries import QUERIES


def sql_texts() -> dict[str, str]:
    texts = {}
    for key, body in ORACLES.items():
        texts[key] = shape_sql(expand(body), QUERIES[key][1])
    return texts
