"""All registered queries of the reference's operators, with their SQL equivalents."""

from tidemark.plans import arrivals, assessments, axes, classified, evaluation, ledgers, market, plugged, portfolio, positions, posts, posts_extra, relational, scores, series, strategies, texts, tickers, upkeep
from tidemark.plans import extras  # noqa: I001  its regime table needs the market plans
from tidemark.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "arrivals", "assessments", "axes", "classified", "evaluation", "extras", "ledgers", "market", "plugged", "portfolio", "positions", "posts", "posts_extra", "relational", "scores", "series", "strategies", "texts", "tickers", "upkeep"]
