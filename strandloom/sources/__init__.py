"""File formats as DataFrames, and back."""

from .formats import read_bed, read_fasta, read_fastq, read_fx, read_gtf, read_kv, read_patterns, read_primers, read_tab, register, write_fx, write_tsv

__all__ = ["read_bed", "read_fasta", "read_fastq", "read_fx", "read_gtf", "read_kv", "read_patterns", "read_primers", "read_tab", "register", "write_fx", "write_tsv"]
