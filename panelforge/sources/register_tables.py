"""Tables of the older pollutant register."""

# Columns and types of every table, as published.
REGISTER_TABLES = {
    "UPLOADEDREPORTS": """
        Code string, LOV_CountryID int, ReportingYear int, CurrentlyShown int, RemarkText string,
        CdrUrl string, CdrUploaded timestamp_ntz, CdrReleased timestamp_ntz,
        ForReview timestamp_ntz, Published timestamp_ntz, ResubmitReason string,
        ImportedToEPRTRMaster timestamp_ntz
    """,
    "POLLUTANTRELEASEANDTRANSFERREPORT": """
        PollutantReleaseAndTransferReportID int, CountryCode string, CountryName string,
        ReportingYear int, CoordinateSystemCode string, CoordinateSystemName string,
        CdrReleased timestamp_ntz, Published timestamp_ntz
    """,
    "POLLUTANTRELEASE": """
        PollutantReleaseID int, FacilityReportID int, ReleaseMediumCode string,
        ReleaseMediumName string, PollutantCode string, PollutantName string,
        PollutantGroupCode string, PollutantGroupName string, PollutantCAS string,
        MethodBasisCode string, MethodBasisName string, TotalQuantity double,
        AccidentalQuantity double, UnitCode string, UnitName string, ConfidentialIndicator int,
        ConfidentialityReasonCode string, ConfidentialityReasonName string
    """,
    "FACILITYID_CHANGES": """
        CountryCode string, ReportingYear int, FacilityReportID int, NationalID string,
        NewFacilityID int, OldFacilityID int
    """,
    "FACILITYREPORT": """
        FacilityReportID int, PollutantReleaseAndTransferReportID int, FacilityID int,
        NationalID string, ParentCompanyName string, FacilityName string, StreetName string,
        BuildingNumber string, City string, PostalCode string, CountryCode string,
        CountryName string, Lat double, Long double, RBDSourceCode string, RBDSourceName string,
        NUTSRegionSourceCode string, NUTSRegionSourceName string,
        NACEMainEconomicActivityCode string, NACEMainEconomicActivityName string,
        CompetentAuthorityName string, CompetentAuthorityAddressStreetName string,
        CompetentAuthorityAddressBuildingNumber int, CompetentAuthorityAddressCity string,
        CompetentAuthorityAddressPostalCode int, CompetentAuthorityAddressCountryCode string,
        CompetentAuthorityAddressCountryName string,
        CompetentAuthorityTelephoneCommunication string,
        CompetentAuthorityFaxCommunication string, CompetentAuthorityEmailCommunication string,
        CompetentAuthorityContactPersonName string, ProductionVolumeProductName string,
        ProductionVolumeQuantity int, ProductionVolumeUnitCode string,
        ProductionVolumeUnitName string, TotalIPPCInstallationQuantity int, OperatingHours int,
        TotalEmployeeQuantity int, WebsiteCommunication string, PublicInformation string,
        ConfidentialIndicator int, ConfidentialityReasonCode string,
        ConfidentialityReasonName string, ProtectVoluntaryData int, MainIASectorCode string,
        MainIASectorName string, MainIAActivityCode string, MainIAActivityName string,
        MainIASubActivityCode string, MainIASubActivityName string
    """,
    "ACTIVITY": """
        ActivityID int, FacilityReportID int, FacilityReportName string,
        AnnexIActivityCode string, AnnexIActivityName string, AnnexIActivityIPPCCode string,
        RankingNumeric int, MainActivityIndicator int
    """,
}
