"""DataFrame operators: retrieval, ranking, metrics, statistics, ledgers, audits."""
