"""Strandloom: nucleotide-resolution genomics analytics as PySpark DataFrame operators."""
