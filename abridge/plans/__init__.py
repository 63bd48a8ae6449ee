"""Registered queries; importing the modules fills the registry."""


def load_all() -> None:
    from abridge.plans import (adapt_queries, answer_queries, eval_queries, full_queries, geo_queries, method_queries, prep_queries,  # noqa: F401
                               request_queries, sweep_queries, text_queries)
