"""Plans made of operators: strategies, ledger, verdicts, sweeps, portfolios, reports."""
