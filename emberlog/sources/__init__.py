"""Readers and writers of logs and forensic artefacts."""
