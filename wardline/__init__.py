"""Link-safety jobs on Spark: text repair, link extraction, page inspection, scoring and alerts as DataFrame operators."""
