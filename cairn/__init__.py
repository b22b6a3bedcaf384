"""cairn: DataFrame operators for searching and organising implementation knowledge at cluster scale."""
