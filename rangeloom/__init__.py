"""rangeloom: range planning, ledgers and assignment over large id spaces, as Spark DataFrame operators."""
