"""Part of the tallybook engine."""
