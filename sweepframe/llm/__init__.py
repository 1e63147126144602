"""Operators for text corpora: tokenizer encoding, packing, personal information. Nothing else imports this subpackage."""
