"""Readers and writers of the tables and files the operators work on."""
