"""Clinical vocabularies and settings for the two glioma recurrence cohorts."""
