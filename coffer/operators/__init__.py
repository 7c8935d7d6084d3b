"""DataFrame -> DataFrame operators: valuation, positions, holdings, prices,
ledger normalisation, upserts, quality audits and exports."""
