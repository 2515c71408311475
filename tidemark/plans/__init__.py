"""End-to-end plans composed from sources and operators."""
