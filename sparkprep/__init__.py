"""sparkprep: supply-chain data preparation and analytics as Spark DataFrame operators."""
