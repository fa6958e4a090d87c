"""Readers and writers of transcripts, annotations, manifests, audio and reports."""
