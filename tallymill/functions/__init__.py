"""Part of tallymill; see the README for what each module holds."""
