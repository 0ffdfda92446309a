"""hirelens: Spark-native analytics over job-posting data.

Bronze (raw postings) -> silver (cleaned, deduplicated postings) -> gold
(dashboard aggregates, audits, inference, skill graph, salary models), all
expressed as DataFrame plans so Catalyst/AQE choose the physical strategy.
"""

__version__ = "0.1.0"
