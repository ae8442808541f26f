"""orderloom: order and supply-chain analytics expressed as Spark plans."""
