"""Training-data operators. Nothing outside this subpackage imports it.

Modules: quality_rules (1), piece_codec (2), sharding (3), license_scan (4),
near_dedup (5), line_dedup (6), decontaminate (7), html_text (8), pii (9),
quality_knn (10), hard_negatives (11), resample (12), secret_scan (13); queries (driver queries and their SQL).
"""
