"""The registered queries and their SQL twins, one module per family."""

from . import leaderboards, payloads, records, snapshots, streams

QUERIES, ORACLES = {}, {}
for _module in (records, snapshots, leaderboards, payloads, streams):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
